"""Line-first cleaning: rules drop lines, then documents that lost too much of their text."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auctionstream.llm.common import WORD, let, words

WINDOW = 5
LEAST_WORDS = 10
#: Percent of the words that may stand in repeated windows.
MOST_REPEATED = 20
#: Share of the word characters that the line rules may take away.
MOST_LOST = 0.5

# Patterns of lines that are not prose.
ENDINGS = "[.!?…:;,\"'”’»)\\]。！？]\\s*$"
LOUD = "[!?]{2,}|[#*$%&|<>]{2,}"
SEPARATORS = "(^|\\s)[|»›>·•/]+(?=\\s|$)"
MENU_WORDS = "^\\W*(home|menu|about( us)?|contact( us)?|login|log in|sign (in|up)|search|next|previous|back to top|share|print)\\W*$"
BOILERPLATE = (
    "all rights reserved", "licen[sc]ed under", "released under the", "privacy policy", "terms of (use|service)",
    "cookie", "enable javascript", "subscribe to", "click here", "©|\\(c\\) ?\\d{4}|copyright \\d{4}",
)
#: Longer lines with such a phrase are prose about it.
BOILERPLATE_WORDS = 25


def bad_line(line: Column) -> Column:
    """Whether a line fails a rule of punctuation, navigation or boilerplate. Lines without a word don't."""
    n = F.regexp_count(line, F.lit(WORD))
    loud = F.regexp_count(line, F.lit(LOUD))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    punctuation = (loud >= 2) & (loud * 5 >= n) | ~line.rlike(ENDINGS) & (n <= 3)
    navigation = (separators >= 2) & (separators * 5 >= n) | line.rlike(f"(?i){MENU_WORDS}")
    boilerplate = (n <= BOILERPLATE_WORDS) & line.rlike(f"(?i){'|'.join(BOILERPLATE)}")
    return (n > 0) & (punctuation | navigation | boilerplate)


def _repeated_words(found: Column) -> Column:
    """Words that stand in a window of five found twice or more, from the array of words.

    Windows are compared by 64-bit hashes. Only texts with a repeated window are sorted.
    """
    window = lambda w, i: F.xxhash64(w, *[F.get(found, i + k) for k in range(1, WINDOW)])

    def covered(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def places(ordered: Column) -> Column:
            near = lambda i, k: F.coalesce(F.get(ordered, i + k)["h"] == F.get(ordered, i)["h"], F.lit(False))
            both = F.transform(ordered, lambda x, i: F.struct(x["i"].alias("i"), (near(i, -1) | near(i, 1)).alias("two")))
            return F.sort_array(F.transform(F.filter(both, lambda x: x["two"]), lambda x: x["i"]))

        def total(starts: Column) -> Column:
            own = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
            return F.aggregate(own, F.lit(0), lambda a, x: a + x)

        return let(let(F.sort_array(pairs), places), total)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    long_enough = F.size(found) >= WINDOW
    starts = F.slice(found, 1, F.greatest(F.size(found) - (WINDOW - 1), F.lit(0)))
    return F.when(long_enough, let(F.transform(starts, window), counted)).otherwise(0)


def _line_facts(text: Column) -> Column:
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def clean(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    clean_text, kept_chars, kept.

    Every line that fails a rule is removed; ``clean_text`` is what remains, its lines joined again.
    ``kept`` needs the base (10 words at least, at most 20 percent of them in repeated five-word windows)
    and a word character share of at most ``most_lost`` in removed lines. Null is an empty text, which
    fails the base. Repeated rows are judged each; other columns are not read. One projection, no
    shuffle; a text's arrays live for its row only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).cast("long").alias("n_repeat_words"),
    )
    good = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~bad_line(line)), "\n")
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), let(words(text), facts).alias("f"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _line_facts(text).cast("long").alias("n_dup_lines"),
        let(good, lambda t: F.struct(
            t.alias("clean_text"),
            F.char_length(F.regexp_replace(t, "[ \\t-\\r]+", "")).cast("long").alias("kept_chars"),
        )).alias("c"),
    ).select("doc_id", "f.*", "n_symbols", "n_dup_lines", "c.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    enough = F.col("kept_chars") >= (1 - most_lost) * F.col("word_chars")
    return found.withColumns({"base_failed": failed, "kept": ~failed & enough})


def cleaned_documents(docs: DataFrame, **options) -> DataFrame:
    """The kept documents as doc_id and cleaned text."""
    return clean(docs, **options).where("kept").select("doc_id", F.col("clean_text").alias("text"))


STATEMENT = reduce(lambda s, kv: s.replace(*kv), {
    "{bad}": f"""(len(regexp_extract_all(l, '{WORD}')) > 0 AND (
        (len(regexp_extract_all(l, '{LOUD}')) >= 2 AND len(regexp_extract_all(l, '{LOUD}')) * 5 >= len(regexp_extract_all(l, '{WORD}')))
        OR (NOT regexp_matches(l, '{ENDINGS.replace("'", "''")}') AND len(regexp_extract_all(l, '{WORD}')) <= 3)
        OR (len(list_filter(string_split_regex(l, '\\s'), lambda x: regexp_full_match(x, '[|»›>·•/]+'))) >= 2
            AND len(list_filter(string_split_regex(l, '\\s'), lambda x: regexp_full_match(x, '[|»›>·•/]+'))) * 5 >= len(regexp_extract_all(l, '{WORD}')))
        OR regexp_matches(l, '(?i){MENU_WORDS}')
        OR (len(regexp_extract_all(l, '{WORD}')) <= {BOILERPLATE_WORDS} AND regexp_matches(l, '(?i){'|'.join(BOILERPLATE)}'))))""",
}.items(), """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^ \\t-\\r]+') AS ws FROM d),
windows AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) t(k) GROUP BY r),
lines AS (SELECT r, l FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)),
line_facts AS (
  SELECT r, count(*) FILTER (w) - count(DISTINCT l) FILTER (w) AS dup,
    sum(CASE WHEN bad THEN 0 ELSE chars END) AS kept_chars
  FROM (SELECT r, l, regexp_matches(l, '[^ \\t-\\r]') AS w, length(regexp_replace(l, '[ \\t-\\r]+', '', 'g')) AS chars, {bad} AS bad FROM lines)
  GROUP BY r),
facts AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, kept_chars
  FROM w JOIN line_facts USING (r) LEFT JOIN covered c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND kept_chars >= 0.5 * word_chars AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts)
""")

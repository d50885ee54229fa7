"""Benchmark passages in documents, also with other numbers, names and units: template windows."""

from pyspark.sql import Column, DataFrame, functions as F

from auctionstream.llm.common import id_key, let
from auctionstream.session import stage

WINDOW = 5
#: Share of an item's windows that makes a document contaminated.
LEAST_COVERAGE = 0.8
#: So many windows of an item in one place (13 words in a row) do as well.
LEAST_RUN = 9
#: A window needs so many words that are no placeholders.
LEAST_LITERALS = 2
#: Windows of a benchmark that are broadcast; about 100 bytes each.
MOST_BROADCAST = 500_000

NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
# Units that a number may carry.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yard", "yards", "mi", "mile", "miles", "mg", "g", "kg",
    "lb", "lbs", "oz", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second",
    "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "kmh", "mph", "dollar", "dollars", "cent", "cents", "euro", "euros", "pound", "pounds", "percent", "degree", "degrees", "meter",
    "meters", "metre", "metres", "gram", "grams", "kilogram", "kilograms", "kilometer", "kilometers", "kilometre", "kilometres",
)
# Words that write a number, and words that are no names though a sentence may begin with them.
UNITS_IN_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
TENS_IN_WORDS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
NUMBER_WORDS = (
    *UNITS_IN_WORDS, *TENS_IN_WORDS, "zero", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "hundred", "thousand", "million", "billion",
)
NO_NAMES = (
    "a", "after", "all", "an", "and", "are", "as", "at", "before", "but", "by", "calculate", "can", "do", "does", "each", "every", "find",
    "for", "from", "has", "have", "he", "her", "his", "how", "i", "if", "in", "is", "it", "its", "many", "much", "not", "of", "on", "or",
    "she", "so", "some", "that", "the", "their", "then", "there", "these", "they", "this", "those", "to", "was", "we", "were", "what",
    "when", "where", "which", "who", "why", "with", "you", "your",
)
#: Marks a word of an item that stands for a name only where the document has the same word with a capital.
SAME = "="

#: What stands between words; marks in a text do as well.
GAP = "[^\\p{L}\\p{N}\\p{M}]+"
#: Sorts after all marks and before all letters and digits.
MARKS_END = "\x04"


def _with_single_numbers(text: Column) -> Column:
    """Every number one word: no separators inside, no letters behind; twenty-five is one word, too."""
    digits = F.regexp_replace(F.regexp_replace(text, "(?<=\\d)[.,](?=\\d)", ""), "(\\d)(?=\\p{L})", "$1 ")
    plain = F.when(text.rlike("[0-9]"), digits).otherwise(text)
    hyphen = f"(?i)(?<![\\p{{L}}\\p{{N}}\\p{{M}}])({'|'.join(TENS_IN_WORDS)})-(?=(?:{'|'.join(UNITS_IN_WORDS)})(?![\\p{{L}}\\p{{N}}\\p{{M}}]))"
    # All tens end alike, which is quickly seen.
    return let(plain, lambda t: F.when(t.contains("ty-") | t.contains("TY-"), F.regexp_replace(t, hyphen, "$1")).otherwise(t))


def _is_number(word: Column) -> Column:
    both = tuple(t + u for t in TENS_IN_WORDS for u in UNITS_IN_WORDS)
    return ((word >= "0") & (word < ":")) | word.isin(*NUMBER_WORDS, *both)


def marked_words(text: Column) -> Column:
    """The words of a text, lower-cased, without punctuation; a mark stands before each number, in digits or
    words, each unit after a number and each capitalised word, wherever it stands, but for NO_NAMES."""
    given = _with_single_numbers(F.coalesce(text, F.lit("")))

    def marked(words: Column, low: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            own = F.get(low, i)
            is_name = (word != own) & word.rlike("^\\p{Lu}") & ~own.isin(*NO_NAMES)
            is_unit = word.isin(*UNITS) & (i > 0) & _is_number(F.get(low, i - 1))
            return (
                F.when(_is_number(own), F.concat(F.lit(NUMBER), own)).when(is_unit, F.concat(F.lit(UNIT), own))
                .when(is_name, F.concat(F.lit(NAME), own)).otherwise(own)
            )

        return F.transform(words, one)

    split = F.array_remove(F.split(given, GAP), "")
    return let(split, lambda words: let(F.transform(words, F.lower), lambda low: marked(words, low)))


def _hash(words: list[Column]) -> Column:
    """The hash of a window from the hashes of its words, so that each word of a text is hashed once."""
    return F.xxhash64(*[F.xxhash64(w) for w in words])


def _template(word: Column) -> Column:
    return F.when(word < MARKS_END, F.substring(word, 1, 1)).otherwise(word)


def _starts(words: Column) -> Column:
    return F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def window_hashes(text: Column) -> Column:
    """The hash of every five template words of a text, by place. In the template a marked word is its mark alone.
    Texts of less than five words have none."""
    of_words = F.transform(marked_words(text), lambda w: F.xxhash64(_template(w)))
    return let(of_words, lambda hashes: F.transform(
        _starts(hashes), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)])
    ))


def windows(text: Column) -> Column:
    """An array of (h, i, slots): the hash of every five template words, where, and the marked words in them."""
    return let(marked_words(text), lambda words: F.transform(_starts(words), lambda w, i: F.struct(
        _hash([_template(F.get(words, i + k)) for k in range(WINDOW)]).alias("h"), i.cast("int").alias("i"),
        F.filter(F.slice(words, i + 1, WINDOW), lambda x: x < MARKS_END).alias("slots"),
    )))


def _forms(words: Column) -> Column:
    """The forms of an item's window that documents may have: each name as a name or in lower case, and at most
    one word in lower case with a capital, since a sentence may begin there. An array of (h, slots, turned)."""
    at = [F.get(words, F.lit(k)) for k in range(WINDOW)]
    is_name = lambda w: w.startswith(NAME)
    may_begin = lambda w: (w >= MARKS_END) & ~w.isin(*NO_NAMES) & ~w.rlike("^\\p{N}")

    def form(turns: Column) -> Column:
        changed = [
            F.when(turns.bitwiseAND(F.lit(1 << k)) == 0, w).when(is_name(w), F.substring(w, 2, 1_000_000))
            .otherwise(F.concat(F.lit(NAME + SAME), w)) for k, w in enumerate(at)
        ]
        slots = F.filter(F.array(*changed), lambda w: w < MARKS_END)
        return F.struct(_hash([_template(w) for w in changed]).alias("h"), slots.alias("slots"), turns.alias("turned"))

    def allowed(turns: Column) -> Column:
        turned = [turns.bitwiseAND(F.lit(1 << k)) != 0 for k in range(WINDOW)]
        fits = [~t | is_name(w) | may_begin(w) for t, w in zip(turned, at)]
        begun = sum(((t & ~is_name(w)).cast("int") for t, w in zip(turned, at)), F.lit(0))
        every = fits[0]
        for x in fits[1:]:
            every &= x
        return every & (begun <= 1)

    masks = F.filter(F.array(*[F.lit(x) for x in range(1 << WINDOW)]), allowed)
    return F.filter(F.transform(masks, form), lambda x: F.size(x["slots"]) <= WINDOW - LEAST_LITERALS)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Per item and form of a window: item_id, h, j (first place), item_slots, n_windows (different ones of the item,
    not counting their other forms)."""
    words = benchmark.select("item_id", marked_words(F.col("text")).alias("words"))
    starts = F.filter(F.transform("words", lambda w, i: i), lambda i: i <= F.size("words") - WINDOW)
    rows = words.select("item_id", "words", F.explode(starts).alias("j")).select("item_id", "j", F.slice("words", F.col("j") + 1, WINDOW).alias("own"))
    marks = F.filter("own", lambda w: w < MARKS_END)
    plain = _hash([_template(F.get("own", F.lit(k))) for k in range(WINDOW)])
    first = rows.where(F.size(marks) <= WINDOW - LEAST_LITERALS).groupBy("item_id", plain.alias("plain")).agg(F.min(F.struct("j", "own")).alias("f"))
    totals = first.groupBy("item_id").agg(F.count("*").alias("n_windows")).withColumnRenamed("item_id", "of")
    forms = first.select("item_id", "f.j", F.explode(_forms(F.col("f.own"))).alias("w"))
    # Of equal forms of several windows that counts which is no changed one.
    one = forms.groupBy("item_id", F.col("w.h").alias("h")).agg(F.min(F.struct((F.col("w.turned") != 0).alias("c"), "j", "w.slots")).alias("f"))
    return one.join(totals, F.col("item_id").eqNullSafe(F.col("of"))).select(
        "item_id", "h", F.col("f.j").cast("int").alias("j"), F.col("f.slots").alias("item_slots"), "n_windows"
    )


def _documents(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), id_key(F.col("doc_id"), F.col("text")).alias("doc_key"),
        F.xxhash64("text").alias("text_hash"), *more,
    )


def _enough(least_coverage: float, least_run: int) -> Column:
    return (F.col("n_matched") / F.col("n_windows") >= least_coverage) | (F.col("run") >= least_run)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least_coverage: float = LEAST_COVERAGE, least_run: int = LEAST_RUN,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, doc_key, text_hash, item_id, n_windows,
    n_matched, coverage and kind ('same', or 'other values' for a re-parameterised item).

    Windows of both sides are joined by their hash. Matches of one item in one place (equal difference of
    positions) are consistent if equal slot values of the item stand against equal values of the document, and
    words of the item that are no names against themselves. Names are found wherever they stand, also
    where a sentence begins; see ``_forms`` for other spellings of a window.
    Consistent places count: an item is found if they cover ``least_coverage`` of its different windows, or
    one place has ``least_run`` of them.

    Slots only ever take matches away. So documents are first joined by bare hashes, and those in which some
    item has matches enough without regard to slots are read again with theirs.

    Windows of the benchmark are broadcast if they are ``most_broadcast`` at most; otherwise both sides are
    shuffled by hash, and AQE splits windows that very many documents share. Null and short texts match
    nothing, items without windows are never found, equal rows give one result, null ids are kept. An
    empty table on either side gives no row. Runs jobs when called and writes below the shared folder.
    """
    items = stage(item_windows(benchmark), "benchmark-windows")
    # Beyond the bound the hint keeps Catalyst, which doesn't know how many windows a text has, from a broadcast.
    items = F.broadcast(items) if items.count() <= most_broadcast else items.hint("merge")
    document = ["doc_id", "doc_key", "text_hash", "item_id", "n_windows"]
    place = (F.col("i") - F.col("j")).alias("place")
    n_matched = F.size(F.array_distinct(F.flatten(F.collect_list("js")))).cast("long").alias("n_matched")
    run = F.max(F.size("js")).alias("run")

    # The hashes are a column of their own before they are exploded: explode, join and count then run as one compiled loop.
    # From an explode that is not outer Catalyst infers a filter on its array, which would compute the column once more.
    hashed = _documents(docs, window_hashes(F.col("text")).alias("hashes"))
    bare = hashed.select("doc_id", "doc_key", "text_hash", F.posexplode_outer("hashes").alias("i", "own")).join(items, F.col("own") == F.col("h"))
    bare = bare.groupBy(*document, place).agg(F.collect_set("j").alias("js")).groupBy(*document).agg(n_matched, run)
    candidates = stage(
        bare.where(_enough(least_coverage, least_run)).select(F.col("doc_key").alias("__k"), F.col("text_hash").alias("__h")).distinct(),
        "benchmark-candidates",
    )

    again = _documents(docs, "text").join(candidates, (F.col("doc_key") == F.col("__k")) & (F.col("text_hash") == F.col("__h")), "left_semi")
    rows = again.select("doc_id", "doc_key", "text_hash", windows(F.col("text")).alias("ws")).select(
        "doc_id", "doc_key", "text_hash", F.explode_outer("ws").alias("w")
    ).select("doc_id", "doc_key", "text_hash", F.col("w.h").alias("own"), F.col("w.i").alias("i"), F.col("w.slots").alias("slots"))
    pairs = F.transform(
        F.arrays_zip("item_slots", "slots"), lambda p: F.struct(p["item_slots"].alias("a"), p["slots"].alias("b"))
    )
    hits = rows.join(items, F.col("own") == F.col("h")).select(*document, "j", place, pairs.alias("pairs"))
    distinct = F.array_distinct(F.flatten(F.collect_list("pairs")))
    places = hits.groupBy(*document, "place").agg(F.collect_set("j").alias("js"), distinct.alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda p: p["a"]))
    same_word = lambda p: p["a"].startswith(NAME + SAME)
    differ = lambda p: F.when(same_word(p), F.concat(F.lit(NAME), F.substring(p["a"], 3, 1_000_000)) != p["b"]).otherwise(p["a"] != p["b"])
    broken = F.exists("pairs", lambda p: same_word(p) & differ(p))
    consistent = places.where((F.size("pairs") == F.size(values)) & ~broken)
    found = consistent.groupBy(*document).agg(n_matched, run, F.max(F.exists("pairs", differ)).alias("other"))
    return found.where(_enough(least_coverage, least_run)).select(
        *document, "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"),
        F.when(F.col("other"), "other values").otherwise("same").alias("kind"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns."""
    found = contaminated(docs, benchmark, **options).select(F.col("doc_key").alias("__k"), F.col("text_hash").alias("__h")).distinct()
    found = stage(found, "benchmark-found")
    key, text = id_key(F.col("doc_id"), F.col("text")), F.xxhash64("text")
    return docs.join(found, (key == F.col("__k")) & (text == F.col("__h")), "left_anti")

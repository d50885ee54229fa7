"""The operators on Spark against brute force, with edge rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import oracle_check
from auctionstream.llm import (
    components, decontamination, licenses, mixing, quality, queries, repeats, sharding, simhash, token_counts, token_files,
    toxicity,
)
from auctionstream.session import work_folder
from llm_rows import prose


WORD = re.compile("[^\x20\x09-\x0d]+")
BYTES = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


@pytest.fixture(scope="session")
def benchmark(spark):
    items = [
        (1, "A train leaves the old station with 12 wagons and Peter counts 30 people in every wagon before it stops."),
        (2, "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall tree nearby"),
        (3, None), (4, "too short"), (None, "an item without an id but with quite enough words to be found anywhere at all"),
    ]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    rows = [(d, i % 2) for i, (d, _, _) in enumerate(odd_rows)] + [(None, 1), (1, None), (999, 1)]
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def everything(spark, benchmark, labels):
    """Every operator as a function of the documents."""
    def tokens(docs):
        path = work_folder(spark, "tokens")
        token_files.write_tokens(docs, path, BYTES, 2)
        return token_files.read_documents(spark, path)

    return {
        "quality": quality.clean, "cleaned": quality.cleaned_documents, "sharding": lambda d: sharding.sharded(d, 5),
        "interleave": lambda d: sharding.interleave(d, 5), "decontamination": lambda d: decontamination.contaminated(d, benchmark),
        "without_benchmark": lambda d: decontamination.without_benchmark(d, benchmark),
        "token_counts": lambda d: token_counts.token_counts(d, PIECES), "classes": simhash.classes, "keep_one": simhash.keep_one,
        "repeats": repeats.remove_repeats, "tokens": tokens,
        "score": lambda d: toxicity.score(d, toxicity.train(d, labels, F.lit(True))),
        "without_toxic": lambda d: toxicity.without_toxic(d, labels, F.lit(True)), "licenses": licenses.scan,
        "taken": mixing.taken_words, "mixed": mixing.mixed_documents,
    }


NAMES = list(everything(None, None, None))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_row(spark, frame, benchmark, labels, name):
    assert everything(spark, benchmark, labels)[name](frame([])).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(spark, frame, odd_rows, benchmark, labels, name):
    docs = frame(odd_rows)
    operator = everything(spark, benchmark, labels)[name]
    plain = operator(docs)
    others = ["size", "score", "start", "group", "taken", "h", "fp", "v", "th", "kept", "part", "item_id", "shard", "words"]
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in others})
    found = operator(wide)
    shared = [c for c in plain.columns if c in found.columns]
    assert set(plain.columns) <= set(found.columns)
    as_rows = lambda df: sorted(map(str, df.select(*shared).collect()))
    assert as_rows(found) == as_rows(plain)


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_quality_facts(frame, odd_rows):
    extra = [(20, "a b c d e f a b c d e g " + prose(9, 80), "q"), (21, "same line here.\n" * 3 + prose(8, 60), "q")]
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = quality.clean(frame(odd_rows + extra)).select("doc_id", *columns).collect()
    expected = Counter((d, *brute_quality(t)) for d, t, _ in odd_rows + extra)
    assert Counter(tuple(r) for r in rows) == expected


def test_lines_are_judged_first(frame):
    body = prose(4, 120)
    junk = "\n".join(["Home | About | Contact | Login", "All rights reserved.", "Win%%% big*** now### at&&&"])
    rows = [(1, f"{junk}\n{body}", "a"), (2, "\n".join(["a%%% b*** c### d&&& e$$$"] * 1 + [f"x{i}%%% y{i}***" for i in range(30)]), "a"), (3, body, "a")]
    found = {r.doc_id: r for r in quality.clean(frame(rows)).collect()}
    assert found[1].kept and found[1].clean_text == body
    assert not found[2].kept and not found[2].base_failed
    assert found[3].kept and found[3].clean_text == body


@pytest.mark.parametrize("rows_per_bucket", [3, 20_000])
def test_shards_follow_the_mixture(frame, odd_rows, rows_per_bucket):
    rows = sharding.sharded(frame(odd_rows), 5, rows_per_bucket=rows_per_bucket).collect()
    expected = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        for source, n in Counter(s for _, _, s in odd_rows).items():
            assert abs(sum(r.source == source for r in own) - n / 5) <= 1.5
    again = sharding.sharded(frame(odd_rows, 7), 5, rows_per_bucket=rows_per_bucket).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_written_shards_keep_slots(spark, frame, odd_rows, tmp_path):
    sharding.write_shards(frame(odd_rows), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(odd_rows) and back.select("shard", "slot").distinct().count() == len(odd_rows)


@pytest.mark.parametrize("most_broadcast", [0, 500_000])
def test_benchmark_items_are_found(frame, benchmark, most_broadcast):
    item = benchmark.where("item_id = 1").first().text
    other = item.replace("12", "45").replace("Peter", "Maria").replace("30", "7")
    mixed_up = item.replace("wagons and", "wagons, then 12 more, and").replace("30", "7")
    rows = [
        (1, f"{prose(1, 30)}\n{item}\n{prose(2, 30)}", "a"), (2, f"So it goes {other} The end", "a"), (3, prose(3, 200), "a"),
        (4, benchmark.where("item_id = 2").first().text[:50], "a"), (5, "2 3 4 5 6 7 8 9 10 11 12 13 14 15", "a"),
        (None, benchmark.where("item_id is null").first().text, "a"), (7, f"{item}\n{item}", "a"), (7, f"{item}\n{item}", "a"), (8, None, "a"),
        (9, mixed_up, "a"),
    ]
    found = decontamination.contaminated(frame(rows), benchmark, most_broadcast=most_broadcast).collect()
    kinds = {(r.doc_id, r.item_id): r.kind for r in found}
    assert kinds.pop((1, 1)) == "same" and kinds.pop((2, 1)) == "other values" and kinds.pop((7, 1)) == "same"
    assert kinds.pop((None, None)) == "same"
    kinds.pop((9, 1), None)
    assert not kinds
    left = decontamination.without_benchmark(frame(rows), benchmark).collect()
    assert {r.doc_id for r in left} >= {3, 4, 5, 8} and not {1, 2, 7, None} & {r.doc_id for r in left}


def test_slots_must_be_consistent(spark, frame):
    item = "if 5 apples cost as much as 5 pears then how much do the 5 plums cost in all"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("5", "8"), "a"), (2, item.replace("5", "8", 1).replace("5", "9", 1), "a")]
    assert [(r.doc_id, r.kind) for r in decontamination.contaminated(frame(rows), bench).collect()] == [(1, "other values")]


def test_token_counts(frame, odd_rows):
    model, _ = token_counts.encoder(PIECES)
    rows = token_counts.token_counts(frame(odd_rows), PIECES, limit=100, chunk=200, overlap=10).collect()
    expected = Counter((d, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for d, t, _ in odd_rows)
    assert Counter(map(tuple, rows)) == expected


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_classes(prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(prints)), 2):
            if label[i] != label[j] and bin(prints[i] ^ prints[j]).count("1") <= 2:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


@pytest.mark.parametrize("largest", [1, 2_048])
def test_simhash_classes(frame, odd_rows, largest):
    base = prose(3, 900)
    near = [(200 + i, base.replace(base.split()[i * 9], f"edit{i}"), "n") for i in range(12)]
    rows = sorted(odd_rows + near, key=key)
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    label = brute_classes(prints)
    least = [min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    found = simhash.classes(frame(rows), largest)
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found.collect())
    assert got == Counter((d, p, c) for (d, _, _), p, c in zip(rows, prints, least))
    kept = simhash.keep_one(frame(rows), largest=largest).collect()
    assert len(kept) == len(set(label))
    assert len({label[rows.index((r.doc_id, r.text, r.source))] for r in kept}) == len(kept)


@pytest.mark.parametrize("largest", [3, 50])
def test_large_buckets_are_refined(spark, largest):
    random.seed(2)
    base = random.getrandbits(64)
    prints = {base}
    while len(prints) < 150:
        x = base
        for _ in range(random.randint(1, 6)):
            x ^= 1 << random.randrange(24)
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    tied = components.components(simhash.links(df, largest)).collect()
    ordered = sorted(prints, key=signed)
    label = brute_classes(ordered)
    groups = defaultdict(set)
    for x, n in zip(ordered, label):
        groups[n].add(signed(x))
    got = defaultdict(set)
    for r in tied:
        got[r.root].add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1_000, i) for i in range(1_001, 1_080)]
    links = spark.createDataFrame(chain + star + [(5, 5), (3, 2)], "u long, v long")
    found = {r.node: r.root for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 1_000 for i in range(1_000, 1_080)}}


def brute_repeats(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for a, b in zip(b"\0" + gone, gone) if b and not a), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, largest_key", [(100, 1_000), (100, 2), (150, 1), (100, 3_500_000)])
def test_repeats(frame, odd_rows, length, largest_key):
    passage = prose(77, 60)
    shared = [(300 + i, f"{prose(400 + i, 30 + i)}\n{passage}\n{prose(500 + i, 25)}", "s") for i in range(14)]
    periodic = [(329, "line again\n" * 900, "p"), (328, "line again\n" * 450 + "other\n", "p"), (330, "ab" * 400, "p"), (331, "abc" * 90 + "x" + "abc" * 90, "p"), (332, passage[:100], "p"), (333, passage[:99], "p")]
    rows = odd_rows + shared + periodic
    found = repeats.remove_repeats(frame(rows), length, largest_key, with_text=True).collect()
    expected = Counter((d, *facts) for (d, _, _), facts in zip(rows, brute_repeats([(t or "").encode() for _, t, _ in rows], length)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == expected
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_token_files(spark, frame, odd_rows):
    library = token_files.tokenizer(BYTES)
    path = work_folder(spark, "tokens")
    token_files.write_tokens(frame(odd_rows), path, BYTES, 2)
    rows = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    ids = {(d, t): [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t, _ in odd_rows}
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    assert got == Counter((d, len(ids[d, t]), zlib.crc32(np.array(ids[d, t], "<u4").tobytes())) for d, t, _ in odd_rows)
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in rows[:3]] == [None] * 3
    [back] = token_files.read_ids(spark, path, 7)
    assert back.tolist() == ids[7, next(t for d, t, _ in odd_rows if d == 7)]
    assert len(token_files.read_ids(spark, path, 6)) == 2


def test_toxicity_learns_and_keeps_all_rows(spark, frame, odd_rows):
    toxic = [(1_000 + i, prose(600 + i, 40) + (" What a vile scoundrel." if i % 4 == 0 else ""), "t") for i in range(160)]
    labels = spark.createDataFrame([(d, int("vile" in t)) for d, t, _ in toxic], "doc_id long, toxic int")
    docs = frame(toxic + odd_rows)
    model = toxicity.train(docs, labels, toxicity.not_held_out("doc_id"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(toxic + odd_rows) and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id >= 1_000}
    assert all(found[d].predicted == int("vile" in t) for d, t, _ in toxic)
    text = toxic[0][1].encode()
    [span] = found[1_000].sentences
    assert text[span.begin : span.end].strip() == b"What a vile scoundrel."
    left = toxicity.without_toxic(docs, labels, F.lit(True))
    assert left.count() == len(odd_rows) + 120 and left.schema == docs.schema


def test_held_out_rule(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), (~toxicity.not_held_out("id")).alias("out"))
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def test_licenses(frame):
    rows = [(1, f"{prose(1, 20)}\nReleased under the MIT License.\n{prose(2, 20)}", "a"), (2, prose(3, 50), "a"), (3, None, "a"), (4, "İ All rights reserved", "a")]
    found = {r.doc_id: r for r in licenses.scan(frame(rows)).collect()}
    assert set(found) == {1, 4} and found[1].license == "MIT"
    assert rows[0][1][found[1].begin : found[1].end] == "Released under the MIT License"
    assert rows[3][1][found[4].begin : found[4].end] == "All rights reserved"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return {**capped, **{s: level * weight[s] for s in rest}}
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("rows_per_bucket", [2, 20_000])
def test_mix(frame, odd_rows, rows_per_bucket):
    rows = odd_rows + [(500 + i, prose(900 + i, 300), f"m{i % 5}") for i in range(25)]
    found = mixing.taken_words(frame(rows), rows_per_bucket=rows_per_bucket).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(dict(sizes))
    source = {(d, len(WORD.findall(t or ""))): s for d, t, s in rows}
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in rows)
    taken = Counter()
    for r in found:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 64 + 1e-6
    again = mixing.taken_words(frame(rows, 9), rows_per_bucket=rows_per_bucket).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_documents_are_what_the_mix_takes(frame, odd_rows):
    rows = odd_rows + [(500 + i, prose(900 + i, 300), f"m{i % 5}") for i in range(25)]
    docs = frame(rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema.names == docs.schema.names
    taken = Counter()
    for r in mixing.taken_words(docs).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    texts = defaultdict(set)
    for d, t, _ in rows:
        texts[d].update(WORD.findall(t or ""))
    for r in mixed.collect():
        words = WORD.findall(r.text)
        got[r.doc_id] += len(words)
        assert set(words) <= texts[r.doc_id] and r.n_chars == len(r.text)
    assert got == +taken


def test_quality_statement(spark, small_folder):
    df = queries.op1_quality(spark, small_folder)
    expected = oracle_check.duck_rows(oracle_check.connect(small_folder), quality.STATEMENT)
    assert oracle_check.spark_rows(df) == expected


def test_stages_take_effect(spark, small_folder):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    names = docs.columns
    item = spark.read.parquet(f"{small_folder}/benchmark.parquet").first().text
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        path = work_folder(spark, name)
        stage(spark, docs, small_folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        if name == "near-copies":
            assert docs.count() == docs.select("doc_id").distinct().count() < before
        if name == "benchmark":
            assert docs.where(F.contains("text", F.lit(item))).count() == 0
    ends = docs.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert ends[0] == ends[1] and docs.count() == before

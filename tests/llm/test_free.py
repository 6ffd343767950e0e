"""The operators with Arrow tasks, against plain Python, exact round trips and labels."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from brute import components, sha, shingle_set, texts, without_repeats
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_dup, packing, quality, suffix
from tidemark.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def prose(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def edited(rng, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def near_rows():
    rng, rows = random.Random(3), []
    for base in range(6):
        text = prose(rng, 330 if base % 2 else 150)
        rows += [(100 * base + i, edited(rng, text, rng.randrange(7))) for i in range(14)]
    rows += [(900, None), (901, ""), (902, " "), (903, "one two three"), (904, "ONE two\tthree"), (905, "one two"), (906, "a b c d e")]
    return rows + [(907, rows[0][1]), (907, rows[0][1]), (908, rows[0][1].upper()), (909, "y " * 4_000 + "z")]


@pytest.mark.parametrize("sizes", [(8, 1024, 4096), (2, 4, 64)])
def test_near_duplicates(spark, monkeypatch, sizes):
    for name, value in zip(("SMALL_BUCKET", "BLOCK", "STRIP"), sizes):
        monkeypatch.setattr(near_dup, name, value)
    rows = near_rows()
    got = near_dup.near_duplicates(texts(spark, rows).withColumn("n", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == components(rows)


def test_near_duplicates_without_rows_or_keys(spark):
    assert near_dup.near_duplicates(texts(spark, [])).count() == 0
    got = near_dup.near_duplicates(texts(spark, [(None, "a b c"), (None, None), (1, "a b c")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("1", "1", True), ("None", "1", False), ("None", "None", True)
    ]


def test_pipeline_joins_near_duplicates_from_80_percent(spark):
    rng, rows = random.Random(12), []
    for i in range(0, 80, 2):
        # Words far apart are changed: each takes five shingles from both sets.
        n, changes = (150, (40, 75, 110)) if i % 4 else (400, range(30, 390, 50))
        a = prose(rng, n, 9_999)
        w = a.split(" ")
        for at in changes:
            w[at] = "changed"
        one, two = shingle_set(a), shingle_set(" ".join(w))
        assert 0.8 <= len(one & two) / len(one | two) < 0.85
        rows += [(i, a), (i + 1, " ".join(w))]
    docs = texts(spark, rows).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    got = corpus_pipeline.distinct_texts(spark, docs, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 80, 2))
    assert near_dup.band_rows(85) == 5 and near_dup.band_rows(80) == 4


def test_registers_estimate_resemblance(spark):
    rng = np.random.default_rng(1)
    for n, share in ((150, 0.9), (2_000, 0.85), (2_000, 0.0)):
        common = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share)), dtype=np.uint64)
        own = [np.concatenate((common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64))) * np.uint64(2) for _ in "ab"]
        if n <= near_dup.SMALL:
            regs, m = [near_dup.small_registers(x, np.zeros(1, int))[0] for x in own], str(n)
        else:
            regs, m = [near_dup.large_registers(x, np.zeros(len(x), int), 1)[0] for x in own], f"{n} / {near_dup.REGISTERS}"
        frame = spark.createDataFrame([tuple(r.view(np.int16).tolist() for r in regs)], "a array<smallint>, b array<smallint>")
        assert abs(frame.selectExpr(near_dup.estimate("a", "b", m, m)).first()[0] - share) < 0.13


@pytest.mark.parametrize("most_chunks", [2_000, 1])
def test_repeated_strings(spark, monkeypatch, most_chunks):
    monkeypatch.setattr(suffix, "MOST_CHUNKS", most_chunks)
    rng = random.Random(9)
    shared = [prose(rng, 30, 9_999) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(40), 9_999) for _ in range(3)]
        parts.insert(1, rng.choice(shared)[rng.randrange(20) :])
        rows.append((i, "é ".join(parts)))
    rows += [(50, None), (51, ""), (52, "short"), (53, rows[0][1]), (54, "ab" * 300), (55, "q" * 61), (56, "q" * 60), (57, "r" * 60)]
    rows += [(58, rows[1][1]), (58, rows[1][1]), (None, rows[2][1])]
    frame = texts(spark, rows).withColumn("bytes", F.lit("clash"))
    got = suffix.without_repeats(frame, length=60).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(
        key(r) for r in without_repeats([(d if d is not None else "None", t) for d, t in rows], 60)
    )
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got)
    assert suffix.without_repeats(texts(spark, [])).count() == 0


@pytest.mark.parametrize("shared", [150, 70])
def test_no_task_expands_a_crowded_group(spark, monkeypatch, shared):
    expand = suffix.repeated

    def bounded(pieces, length):
        assert len(pieces) <= 10
        return expand(pieces, length)

    for name, value in (("MOST_CHUNKS", 10), ("BYTES_AT_ONCE", 1), ("repeated", bounded)):
        monkeypatch.setattr(suffix, name, value)
    # One passage in many different texts; the shorter one leaves few equal strings and many kinds.
    rng = random.Random(10)
    passage = prose(rng, 60, 99_999)[:shared]
    rows = [(i, f"{prose(rng, 30, 99_999)} {passage} {prose(rng, 30, 99_999)}") for i in range(60)]
    got = suffix.without_repeats(texts(spark, rows), length=60).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(without_repeats(rows, 60))


def test_interval_expansion_alone():
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 60))) for _ in range(30)]
    for length in (5, 9):
        strings = [p[s : s + length] for p in pieces for s in range(len(p) - length + 1)]
        got = suffix.repeated([p for p in pieces if len(p) >= length], length)
        assert [bool(x) for hit in got for x in hit] == [
            strings.count(p[s : s + length]) > 1 for p in pieces if len(p) >= length for s in range(len(p) - length + 1)
        ]


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(900))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "It's <|endoftext|>, ÉCOLE.\nx"), (503, prose(rng, 5_000)), (None, "x"), (504, "a"), (504, "a")]
    got = packing.pack(texts(spark, rows).coalesce(2).withColumn("start", F.lit("clash")), tokenizer_file()).collect()
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for doc, text in rows:
        if doc != 504:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            own = sorted(pieces[doc], key=lambda r: r.start)
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
            assert {r.doc_tokens for r in own} == {len(ids)} and sum(r.length for r in own) == len(ids)
            assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert sum(r.length for r in pieces[504]) == 2 * pieces[504][0].doc_tokens
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
    assert sum(sum(r.length for r in own) < 2048 for own in windows.values()) <= 2
    assert packing.pack(texts(spark, []), tokenizer_file()).count() == 0


def test_level_array_takes_the_least_sum_of_squares():
    rng, windows = random.Random(6), packing.Windows(40)
    for _ in range(300):
        n, counts = rng.randrange(1, 40), windows.counts.copy()
        best = None
        for level in range(0, 41 - n):
            if level == 0 or counts[level]:
                after = counts.copy()
                after[level] -= level > 0
                after[level + n] += level + n < 40
                best = min(best or 10**9, int((after**2).sum()))
        windows.put((0, 0, np.zeros(n), 0))
        assert int((windows.counts**2).sum()) == best
        assert [len(windows.open.get(i, [])) for i in range(1, 40)] == windows.counts[1:40].tolist()


def test_quality_on_held_out_labels(spark):
    found = quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "good", "score")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    assert len(rows) > 300
    assert sum(r.good == (r.quality == 1) for r in rows) / len(rows) > 0.97
    assert sum(r.good for r in rows if r.quality == 1) / sum(r.quality == 1 for r in rows) > 0.98


def test_toxic_texts_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"])
    labelled = docs.join(labels, "doc_id")
    rows = labelled.select("doc_id", "lang", "quality", F.col("toxic").alias("label")).collect()
    kept = {r.doc_id for r in quality.kept(labelled.select("doc_id", "text")).collect()}
    # The abuse of the other languages is invented, anew for each table, and on no list.
    toxic = [r for r in rows if r.label == 1 and r.quality == 1 and r.lang == "en"]
    clean = [r for r in rows if r.label == 0 and r.quality == 1]
    assert len(toxic) > 20 and sum(r.doc_id not in kept for r in toxic) / len(toxic) > 0.95
    assert sum(r.doc_id in kept for r in clean) / len(clean) > 0.98


def test_toxic_words_wherever_they_stand(spark):
    calm = "Good friends walk slowly home. " * 400
    rows = [(1, "You idiot."), (2, "You friend."), (3, calm + "Idiot, moron! SCUM (worthless) "), (4, calm + "He felt stupid. "), (5, None)]
    rows += [(6, "Du Trottel!"), (7, "Espèce d'abrutis."), (8, "¡Gilipollas!"), (9, "A scummy pond.")]
    got = quality.judged(texts(spark, rows)).collect()
    assert {r.doc_id: r.toxic for r in got} == {i: i in (1, 3, 6, 7, 8) for i in range(1, 10)}


def test_variety_counts_all_words(spark):
    rng, at = random.Random(8), list(quality.LABELLERS).index("variety")
    varied, spam = prose(rng, 400, 9_999), " buy now cheap" * 3_000
    rows = [(1, varied), (2, varied + spam), (3, prose(rng, 9_700, 9_999)), (4, "a b c " * 100), (5, "one"), (6, " ")]
    got = quality.measured(texts(spark, rows), "text").collect()
    assert {r.doc_id: r.votes[at] for r in got} == {1: 1, 2: -1, 3: 1, 4: -1, 5: 1, 6: 0}


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Fine words here."), (3, "Fine words here."), (4, "x" * 100_000), (None, "a b, c.")]
    df = texts(spark, rows).withColumn("score", F.lit("clash"))
    got = quality.judged(df).collect()
    assert len(got) == len(rows) and {r.good for r in got if r.doc_id in (1, 2)} == {False}
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert quality.judged(texts(spark, [])).count() == 0
    assert quality.kept(df).columns == df.columns


def test_votes_reveal_accuracies():
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random(votes.shape) < 0.2] = 0
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    prior, chances = quality.estimate(list(zip(map(tuple, kinds.tolist()), counts.tolist())))
    assert abs(prior - 0.7) < 0.05
    assert np.abs(chances[:, 1, 2] - right).max() < 0.06 and np.abs(chances[:, 0, 0] - right).max() < 0.06


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"start": docs.count()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        kept[name] = docs.count()
    assert kept["start"] > kept["quality"] > kept["near_duplicates"] >= kept["decontamination"] == kept["personal_data"] > 0
    bad = duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 0").fetchall()
    assert not {r[0] for r in bad} & {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.where("text rlike '[a-z]@mail[0-9]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == kept["personal_data"]

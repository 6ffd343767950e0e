"""Cases that plausible shortcuts get wrong."""

import random
import unicodedata

import corpus_pipeline
import numpy as np
import pytest
from brute import sha, texts
from test_free import prose
from tokenizers import Tokenizer

from tidemark.llm import job, packing, quality, sketch, suffix
from tidemark.llm.queries import tokenizer_file


def structured_pair():
    """Two texts without a common string of 200 bytes whose polynomial hashes modulo 2**64 are equal for every odd base."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    runs = [make(suffix.GRAM) for _ in range(5_000)]
    hashes = [int(suffix.Hashes(np.frombuffer(r.encode(), np.uint8)).of(np.array([0]), np.array([suffix.GRAM]))[0]) for r in runs]
    common = runs[int(np.argmin(np.array(hashes, np.uint64)))]
    blocks = [common + make(23) for _ in range(64)]
    flips = [bin(i).count("1") % 2 for i in range(64)]
    return ["".join(b + "AC"[f ^ side] for b, f in zip(blocks, flips)) for side in (0, 1)]


def test_structured_strings_are_not_taken_for_equal(spark):
    one, two = structured_pair()
    assert not {one[i : i + 200] for i in range(len(one) - 199)} & {two[i : i + 200] for i in range(len(two) - 199)}
    hashes = [suffix.Hashes(np.frombuffer(t.encode(), np.uint8)).of(np.array([0]), np.array([len(t)]))[0] for t in (one, two)]
    assert hashes[0] == hashes[1]
    got = suffix.without_repeats(texts(spark, [(1, one), (2, two), (3, one[:300])])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 300, 2: 0, 3: 300}


def test_structured_strings_in_crowded_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix, "MOST_CHUNKS", 1)
    one, two = structured_pair()
    rows = [(1, one), (2, two), (3, "x" + one[:250]), (4, "y" + two[700:950])]
    got = {r.doc_id: r for r in suffix.without_repeats(texts(spark, rows)).collect()}
    assert {k: r.n_removed for k, r in got.items()} == {1: 250, 2: 250, 3: 250, 4: 250}
    assert got[3].kept_sha256 == sha("x")


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_training_is_bounded_whatever_texts_repeat(spark, monkeypatch, most):
    seen, train = [], quality.trained

    def watched(rows, cells, shares, good, rounds=200):
        seen.append(len(good))
        return train(rows, cells, shares, good, 5)

    monkeypatch.setattr(quality, "trained", watched)
    rng = random.Random(12)
    rows = [(i, "The same text, again and again.") for i in range(3_000)] + [(i, prose(rng, 60)) for i in range(150)]
    assert quality.judged(texts(spark, rows), most_trained=most).count() == len(rows)
    assert all(n <= most for n in seen) and (most < 10_000 or seen == [151])


def test_marks_after_letters_that_decompose():
    tokenizer = Tokenizer.from_file(tokenizer_file())
    words = packing.Words(tokenizer_file())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    odd = [c for c in every if unicodedata.normalize("NFC", c).lower() != c]
    some = [f.format(c) for c in odd + every[::37] for f in ("{}.", "x{}!", "{}.a")]
    words.learn(set(some))
    told = tokenizer.encode_batch(some, add_special_tokens=False)
    assert [w for w, e in zip(some, told) if words[w] != np.array(e.ids, "<u4").tobytes()] == []


def test_next_document_of_large_ids(spark):
    rng = random.Random(13)
    ids = sorted({(1 << 60) + rng.randrange(600) for _ in range(400)})
    rows = [(i, f"text {i}") for i in ids]
    rng.shuffle(rows)
    got = sketch.followed(texts(spark, rows), "doc_id", "text", "next", rows_each=16).collect()
    after = dict(zip(ids, ids[1:] + ids[:1]))
    assert {r.doc_id: r.next for r in got} == {i: f"text {after[i]}" for i in ids}


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def test_one_document_of_each_group_under_repeated_ids(spark):
    rng = random.Random(14)
    a, b, c = (prose(rng, 80, 9_999) for _ in range(3))
    rows = [(1, a), (1, a), (2, a), (6, a), (6, b), (7, b + " tail"), (8, c), (None, c), (9, ""), (9, ""), (10, None), (10, None)]
    stage = corpus_pipeline.distinct_texts(spark, documents(spark, rows), "")
    got = sorted(((r.doc_id, r.text) for r in stage.collect()), key=str)
    assert stage.columns == list(corpus_pipeline.COLUMNS)
    # Of texts that are alike the smallest id stays; a null id is the smallest.
    assert got == sorted([(1, a), (6, b), (None, c), (9, ""), (10, None)], key=str)


def test_scratch_is_shared_on_a_cluster():
    class Conf:
        def get(self, name, other):
            return None

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="all executors share"):
        job.saved(Frame())

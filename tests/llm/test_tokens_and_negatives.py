"""Token counts against the library, hard negatives against all pairs."""

import random

import brute_new as brute
import pytest
from brute import texts

from tidemark.llm import negatives, queries, tokens

SF = "/root/testdata/sf0.001"
MODEL = queries.tokenizer_file("piece_bpe_32k.model")
VECTORS = "vec_id bigint, embedding array<double>, label int"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(5)
    letters = " \n\t▁a.é中<>s/\r\x00　\xa0Aﬁ0x​th ing한😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return made + ["", " ", "  ", "\n", "▁", "a ", " a", "<s>", "</s>", "<unk>", "<0x0A>", "a" * 50_000, "中" * 20_000, " " * 5_000, "\n" * 3_000, "a b " * 40_000]


def test_counts_equal_the_library(library):
    rows = odd_texts()
    assert tokens.Counts(MODEL).of(rows) == [len(library.encode(t)) for t in rows]


def test_whole_tokens_are_proven(library):
    whole = tokens.Counts(MODEL).whole
    assert len(whole) > 31_000
    for word in list(whole)[::997]:
        assert len(library.encode("\n" + word)) == len(library.encode("\n")) + 1


def test_with_tokens_keeps_rows_and_other_columns(spark):
    rows = [(1, None, 5, True), (1, "two words", 6, None), (1, "two words", 6, None), (None, "", 7, False)]
    df = texts(spark, rows, "doc_id bigint, text string, n_tokens int, over_limit boolean")
    got = sorted(map(tuple, tokens.with_tokens(df, MODEL, limit=1).collect()), key=str)
    assert got == sorted([(1, None, 0, False), (1, "two words", 2, True), (1, "two words", 2, True), (None, "", 0, False)], key=str)
    assert tokens.with_tokens(df.limit(0), MODEL).collect() == []


def test_token_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").collect()}
    got = {r.doc_id: tuple(r) for r in queries.op12_token_counts(spark, SF).collect()}
    want = {k: len(library.encode(t)) for k, t in docs.items()}
    assert got == {k: (k, len(t.encode()), want[k], want[k] > 4096) for k, t in docs.items()}


def mined(spark, rows, schema=VECTORS, **options):
    df = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, negatives.hard_negatives(df, "vec_id % 5 = 0", **options).collect()))


def vectors(seed, many, largest, kinds=3):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-largest, largest) for _ in range(4)], rng.randrange(kinds)) for i in range(many)]


@pytest.mark.parametrize("largest", [0.02, 1.0, 1e4, 1e6])
def test_negatives_equal_all_pairs(spark, largest):
    rows = vectors(1, 150, largest)
    rows += [(1000 + i, rows[i % 3][1], i % 2) for i in range(40)]
    want = brute.hard_negatives(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want


def test_groups_and_blocks_do_not_change_the_answer(spark, monkeypatch):
    rows = vectors(2, 120, 1.0)
    monkeypatch.setattr(negatives, "SCORED_AT_ONCE", (3, 7))
    want = brute.hard_negatives(rows, lambda i: i % 5 == 0, positives=3, negatives=2, share=50)
    assert want and mined(spark, rows, rows_each=30, anchors_each=8, positives=3, negatives=2, share=50) == want


def test_rows_without_part_repeated_rows_and_lengths(spark):
    rows = vectors(3, 60, 1.0)
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 4, 1), (200, None, 1), (201, [1.0] * 4, None), (205, [1.0, None, 1.0, 1.0], 0),
           (210, [nan, 1.0, 1.0, 1.0], 0), (215, [inf, 1.0, 1.0, 1.0], 1), (220, [0.5, 0.5], 1), (221, [0.5, 0.4], 1),
           (222, [0.5, 0.45], 0), (225, [], 0), (226, [], 1), (0, [0.1] * 4, 9)]
    rows = rows + odd + rows[:20]
    assert mined(spark, rows) == brute.hard_negatives(rows, lambda i: i % 5 == 0)


def test_empty_table_one_label_and_clashing_names(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(i, [0.1 * i], 1) for i in range(9)]) == []
    schema = VECTORS + ", _id int, _group int, _windows int, key int"
    rows = vectors(4, 40, 1.0)
    assert mined(spark, [(*r, 1, 2, 3, 4) for r in rows], schema) == brute.hard_negatives(rows, lambda i: i % 5 == 0)


def test_score_beyond_a_bigint_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit a bigint"):
        mined(spark, [(0, [1e12, 1e12], 1), (1, [1e12, 1e12], 1)])


def test_negative_query(spark):
    rows = [(r.vec_id, r.embedding, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10)
            for r in queries.table(spark, SF, "embeddings").collect()]
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, SF).collect()))
    assert got and got == brute.hard_negatives(rows, lambda i: i % 100 == 0)

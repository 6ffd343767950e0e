"""Conversation repair against a search over all edits."""

import random

import brute_new as brute
import pytest

from tidemark.llm import queries, repair

SF = "/root/testdata/sf0.001"
ROWS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def answers(spark, rows, schema=ROWS):
    found, messages = repair.repair(spark.createDataFrame(rows, schema))
    told = {r.conv_id: r.sha256 for r in repair.digests(messages).collect()}
    return {r.conv_id: (*(r[c] for c in COLUMNS), told.get(r.conv_id, brute.sha(""))) for r in found.collect()}


def conversations(seed, many, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "cut", "Why?  \n", "", " \t", None, "é?", "ok ."]
    return [
        (conv, None if rng.random() < 0.1 else turn // rng.choice((1, 1, 2)), rng.choice(roles), rng.choice(texts))
        for conv in range(many) for turn in range(rng.randint(1, longest))
    ]


def spaced(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


def test_random_conversations(spark):
    rows = conversations(1, 150, 9)
    assert answers(spark, rows) == brute.repair(spaced(rows), {r[0] for r in rows})


def test_chunks_do_not_change_the_answer(spark, monkeypatch):
    rows = conversations(2, 12, 60)
    monkeypatch.setattr(repair, "CHUNK_ROWS", 3)
    monkeypatch.setattr(repair, "CHUNK_LETTERS", 20)
    assert answers(spark, rows) == brute.repair(spaced(rows), {r[0] for r in rows})


def test_one_conversation_of_all_rows_and_many_equal_rows(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"Text {i}.") for i in range(3000)]
    rows += [(7, 50, "user", "again")] * 3000 + [(None, None, None, None)] * 5
    got = answers(spark, rows)
    assert got[7][:6] == (0, 0, 2999, 1, 3000, 6000) and got[7][6].count("D") == 3000
    assert got[None] == (0, 5, 0, 0, 4, 10, "DDDDD", brute.sha(""))


@pytest.mark.parametrize("rows, edits", [
    ([(1, 0, "system", "S.")], "D"),
    ([(1, 0, "user", "Q?"), (1, 1, "user", "A.")], "KR"),
    ([(1, 0, "assistant", "A.")], "D"),
    ([(1, 0, "user", "Q?"), (1, 1, "assistant", "")], "DD"),
    ([(1, 0, "user", "Q? "), (1, 1, "assistant", "x"), (1, 2, "user", "Q?"), (1, 3, "assistant", "A.")], "DDKK"),
])
def test_known_edits(spark, rows, edits):
    assert answers(spark, rows)[1][6] == edits


def test_empty_table_and_clashing_names(spark):
    assert answers(spark, []) == {}
    schema = ROWS + ", conv int, part int, no int, symbols string, fault string, copies int, _said string"
    rows = [(1, 0, "user", "Q?", 1, 2, 3, "a", "b", 4, "c"), (1, 1, "assistant", "A.", 1, 2, 3, "a", "b", 4, "c")]
    assert answers(spark, rows, schema)[1][5:7] == (0, "KK")


def test_very_long_text(spark):
    long = "word " * 300_000
    got = answers(spark, [(1, 0, "user", long + "?"), (1, 1, "assistant", long)])
    assert got[1][:7] == (0, 0, 0, 1, 0, 4, "DD")


def test_rules_are_shared_and_do_not_change_products():
    rng = random.Random(3)
    plain = repair.Grammar([])
    rules = repair.Grammar([("", "ua"), ("", ""), ("", "xx"), ("", "sU")])
    for _ in range(60):
        symbols = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(1, 12)))
        assert plain.of(symbols) == rules.of(symbols)
    assert len(rules.packed("uauauaua")) == 2


def test_query_over_a_whole_table(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (*(r[c] for c in COLUMNS), r.repaired_sha256) for r in queries.op11_repair(spark, SF).collect()}
    assert got == brute.repair(brute.damage(rows), {r[0] for r in rows})

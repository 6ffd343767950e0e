"""The operators that are DataFrame expressions, against plain Python."""

import random

import pytest
from brute import base_spans, bench_words, contamination, sha, texts
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, pii, sharding, sketch, urls

LONG = "x" * 50_000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "é 💡 a@b.cd, 1.2.3.4 +1 (555) 010-9999"), (4, "é 💡 a@b.cd, 1.2.3.4 +1 (555) 010-9999"),
    (5, "a@b@c.d e@f.g_h@i.j 1.2.3.4.5.6.7.8 300.1.1.1 007.1.1.1"), (6, "4111 1111 1111 1111 4111-1111-1111-1112"),
    (7, LONG + "@" + LONG), (8, "1" * 30_000), (9, "+1" + " " * 9_000 + "2345678 9"), (None, "x@y.zz"), (10, "a@" + "b." * 4_000 + "c"),
]


def spans_of(rows):
    return {(r.doc_id, tuple((x.kind, x.s, x.e) for x in r.base)) for r in rows}


def test_base_spans(spark):
    found = pii.find(texts(spark, ODD)).collect()
    assert len(found) == len(ODD)
    wanted = {(d, tuple((pii.KINDS.index(k), s, e) for k, s, e in base_spans(t or ""))) for d, t in ODD}
    assert spans_of(found) == wanted
    assert all(r.added == [] for r in found)


def test_contexts_give_away_unseen_identifiers(spark):
    rows = [(i, f"words before mailto: user{i}@site.example after") for i in range(12)]
    rows += [(100, "then mailto: jane#doe77 here"), (101, "the room 4711 here"), (102, "mailto: jane#doe77")]
    found = {r.doc_id: r.added for r in pii.find(texts(spark, rows), rounds=2).collect()}
    assert [(x.kind, x.s, x.e) for x in found[100]] == [(0, 13, 23)]
    assert [(x.s, x.e) for x in found[102]] == [(8, 18)]
    assert all(not found[i] for i in [*range(12), 101])


def test_second_round_patterns_runs_and_contexts_by_place(spark):
    rows = [(i, f"w{'abcdefghijkl'[i]} mailto: user{i}@site.example then") for i in range(12)]
    rows += [(100 + i, f"see mailto: jane#doe7{i} x{i}x") for i in range(6)]
    rows += [(200 + i, f"with handle jane#doe7{i} y{i}y") for i in range(6)]
    rows += [(300, "a handle new#one99 so"), (301, "room 4711 here"), (302, "handle"), (303, "")]
    rows += [(400 + i, f"call ph1: +1 555 010 99{10 + i} now") for i in range(12)]
    rows += [(420, "the ph1: 5551234 x"), (421, "the ph1: (555) 123-4567 x"), (422, "other 1 555 010 9911. x")]
    df = texts(spark, rows).selectExpr("*", "'mine' as base", "'mine' as cands", "1 as _row", "2 as _t", "3 as kind", "4 as m")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    added = {d: [(x.kind, x.s, x.e) for x in r.added] for d, r in found.items() if r.added}
    wanted = {100 + i: [(0, 12, 22)] for i in range(6)} | {200 + i: [(0, 12, 22)] for i in range(6)}
    # The handle is a pattern only once its six values are known from mailto:.
    wanted |= {300: [(0, 9, 18)], 420: [(3, 9, 16)], 421: [(3, 10, 23)]}
    # A seed without its plus sign.
    wanted |= {422: [(3, 6, 20)]}
    assert added == wanted
    assert all((r.cands, r._row, r._t, r.kind, r.m) == ("mine", 1, 2, 3, 4) and len(r) == 8 for r in found.values())
    first = {r.doc_id for r in pii.find(texts(spark, rows), rounds=1).where("size(added) > 0").collect()}
    assert 300 not in first and 200 in first


def test_no_pattern_supports_itself(spark):
    rows = [(i, f"id= a{i}@b.cd") for i in range(3)] + [(10 + i, f"id= thing{i}") for i in range(60)]
    assert pii.find(texts(spark, rows)).where("size(added) > 0").count() == 0


def test_masking(spark):
    t = "to a@b.cd and 1.2.3.4!"
    row = pii.find(texts(spark, [(1, t), (2, None)]), keep_text=True)
    got = dict(row.selectExpr("doc_id", pii.masked("text", "concat(base, added)")).collect())
    assert got == {1: "to <email> and <ip>!", 2: None}


def test_empty_tables(spark):
    none = texts(spark, [])
    assert pii.find(none).count() == 0
    assert decontaminate.contamination(none, texts(spark, [(1, "a b c")], "item_id bigint, text string")).count() == 0
    assert sketch.followed(none, "doc_id", "text", "next").count() == 0
    placed = sharding.place(none, ["doc_id"], {0: 1.0})
    assert sharding.slots(placed, ["doc_id"]).count() == 0


@pytest.mark.parametrize("items", [[], [(1, None), (2, "")], None])
def test_contamination(spark, items):
    rng = random.Random(5)
    vocabulary = ["the", "Ünter", "ab", "x9", "Zz"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    if items is None:
        items = [(i, " ".join(words(n))) for i, n in enumerate([30, 14, 10, 9, 3, 12, 12])] + [(5, None), (None, "q r s")]
        items += [items[0], (77, items[1][1])]
    docs = [(i, " - ".join(words(rng.randrange(60)))) for i in range(40)] + [(900, None), (901, ""), (902, "q, R! s")]
    for i, (_, text) in enumerate(items[:3]):
        docs += [(1000 + i, f"start {(text or '').upper()} end {text}")] * 2
    frame = texts(spark, items, "item_id bigint, text string").withColumn("_text", F.lit("clash"))
    got = decontaminate.contamination(texts(spark, docs).withColumn("n_hit", F.lit(-1)), frame).collect()
    named = [("" if i is None else i, t) for i, t in items]
    key = lambda r: (r[0], r[1], r[2], tuple(r[3]))
    assert sorted(key((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got) == sorted(map(key, contamination(docs, named)))
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_words_are_split_as_stated(spark):
    t = "Ab\x7fc{d}é1_ÀB"
    got = texts(spark, [(1, t)]).selectExpr(f"{decontaminate.words('text', decontaminate.NO_WORD)} as w").first().w
    assert got == bench_words(t)


def test_sharding(spark):
    rows = [(i if i % 7 else None, f"t{i % 5}") for i in range(3_000)]
    df = texts(spark, rows)
    before = sharding.place(df, ["doc_id"], dict.fromkeys(range(16), 1.0))
    both = sharding.place(before, ["doc_id"], dict.fromkeys(range(17), 1.0), "grown")
    got = sharding.slots(both, ["doc_id", "text"], blocks=8).collect()
    assert all(r.grown in (r.shard, 16) for r in got)
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    heavy = sharding.place(df.where("doc_id is not null"), ["doc_id"], {0: 1.0, 1: 3.0}).groupBy("shard").count().collect()
    counts = {r.shard: r["count"] for r in heavy}
    assert 2.5 < counts[1] / counts[0] < 3.6
    with pytest.raises(ValueError):
        sharding.place(df, ["doc_id"], {0: 0.0})


def test_sketch_and_next(spark):
    rows = [(i, " ".join(f"w{(i * 31 + j) % 977}" for j in range(300))) for i in range(0, 60, 3)]
    rows += [(61, None), (62, ""), (64, "one two"), (64, "one two"), (None, "null key"), (65, rows[0][1])]
    got = sketch.followed(texts(spark, rows), "doc_id", "text", "next", rows_each=4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    follows = {(a[0], a[1]): b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1])}
    found = got.collect()
    assert all(r.next == follows[(r.doc_id, r.text)] for r in found if r.doc_id != 64)
    assert sorted(r.next for r in found if r.doc_id == 64) == sorted(["one two", rows[0][1]])
    assert len(found) == len(rows)
    pair = texts(spark, rows).alias("a")
    s = {}
    for r in sketch.with_sketch(pair, "text", "s").collect():
        s.setdefault(r.doc_id, r.s)
    assert s[61] == s[62] == [] and len(s[64]) == 1 and s[65] == s[0] and len(s[0]) == 128


def test_resemblance_and_parts(spark):
    half = " ".join(f"a{i}" for i in range(2_000))
    rows = [(1, half + " " + " ".join(f"b{i}" for i in range(2_000))), (2, half)]
    one, two = (r.s for r in sketch.with_sketch(texts(spark, rows), "text", "s").orderBy("doc_id").collect())
    frame = spark.createDataFrame([(one, two)], "a array<bigint>, b array<bigint>")
    like, inside, n = frame.selectExpr(
        sketch.resemblance("a", "b"), sketch.containment("b", "a"), sketch.distinct("a")
    ).first()
    assert abs(like - 0.5) < 0.15 and inside > 0.8 and abs(n - 3_996) < 1_200
    parts = texts(spark, [(1, half), (1, rows[0][1][len(half) + 1 :]), (2, None)])
    merged = sketch.merge_groups(sketch.with_sketch(parts, "text", "s"), ["doc_id"], "s").collect()
    assert len(merged) == 1 and len(set(merged[0].s) & set(one)) >= 120


URLS = [
    (1, "HTTP://A.Net:80/x?q"), (2, None), (3, "no scheme/x"), (4, "http://sub.example.net/en/1"),
    (5, "http://notexample.net/en/1"), (6, "http://x.org#f"), (7, "http://a.org/fr/é b"), (8, "://"), (9, "https://b.example.com/de/"),
    (4, "http://sub.example.net/en/1"),
]
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def test_url_parts_and_rules(spark):
    df = urls.with_parts(texts(spark, URLS, "page_id bigint, url string"), "url").withColumn("bad", F.lit(None).cast("int"))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, RULES).collect()}
    assert got == {
        (1, "a.net:80", "/x", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "sub.example.net", "/en/1", "example.net/en/", "allow"), (5, "notexample.net", "/en/1", "net/", "block"),
        (6, "x.org", "", None, "allow"), (7, "a.org", "/fr/é b", "org/fr/", "allow"), (8, "", "", None, "allow"),
        (9, "b.example.com", "/de/", "example.com/de/", "block"),
    }
    assert urls.judge(df, RULES).count() == len(URLS)
    assert urls.judge(df.limit(0), RULES).count() == 0


def test_url_tree_splits_unlike_branches_and_merges_others(spark):
    rows = [("h", f"/spam/{i}/p", 1) for i in range(100)]
    rows += [("h", f"/{lang}/{i}", int(i % 10 == 0)) for lang in ("en", "de") for i in range(100)]
    rows += [("h", "/spam/9999/p", None), ("h", "/fr/1", None)]
    got = urls.judge(spark.createDataFrame(rows, "host string, path string, bad int"), {}).collect()
    assert {r.template for r in got if r.path.startswith("/spam")} == {"/spam/*/*"}
    # With too few labels to differ, a branch is merged.
    assert {r.template for r in got if r.path.startswith("/fr")} == {"/*/*"}
    assert all((r.verdict == "block") == r.path.startswith("/spam") for r in got)


def test_url_branches_below_merged_segments_are_pooled(spark):
    slug = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [("h", f"/x/{slug(i)}/casino/", 1) for i in range(500)] + [("h", f"/x/{slug(i)}/about/", 0) for i in range(500)]
    rows += [("h", f"/{'/'.join('d' * 60)}", 0), ("h", "", None), ("", "", None)]
    got = urls.judge(spark.createDataFrame(rows, "host string, path string, bad int"), {}).collect()
    assert len(got) == len(rows)
    assert all((r.verdict == "block") == ("casino" in r.path) for r in got)
    assert {r.template for r in got if "casino" in r.path} == {"/*/*/casino"}


def test_url_branches_that_are_alike_are_one(spark):
    kinds = {"bet": 9, "win": 9, "en": 1, "de": 1}
    rows = [("h", f"/{a}/{i}", int(i % 10 < bad)) for a, bad in kinds.items() for i in range(200)]
    got = urls.judge(spark.createDataFrame(rows, "host string, path string, bad int"), {}).collect()
    assert {(r.path.split("/")[1], r.template, r.verdict) for r in got} == {
        (a, "/*worse/*" if bad == 9 else "/*better/*", "block" if bad == 9 else "allow") for a, bad in kinds.items()
    }


def test_chat_layouts_and_round_trip(spark):
    odd = r"a\b <turn x> </turn>\n\l \\ > \### Assistant: " + "é💡"
    esc = odd.replace("\\", "\\\\").replace('"', '\\"')
    records = [
        (1, f'{{"messages": [{{"role": "user", "content": "{esc}"}}, {{"content": "{esc}", "role": "assistant"}}]}}'),
        (2, '{"completion": "c", "prompt": "p"}'), (3, '{"conversations": [{"from": "a>\\nb\\\\", "value": null}]}'),
        (4, '{"instruction": "i", "input": "", "output": 7}'), (5, '{"instruction": "i", "output": "o"}'),
        (6, '{"question": "q", "answer": "a"}'), (7, '{"other": 1}'), (8, None), (9, "no json"), (10, '{"messages": []}'),
        (2, '{"completion": "c", "prompt": "p"}'),
    ]
    df = spark.createDataFrame(records, "id bigint, record string").withColumn("layout", F.lit("clash"))
    read = chat.parsed(chat.formatted(chat.canonical(df, "record"))).collect()
    by = {r.id: r for r in read}
    assert len(read) == len(records)
    assert [tuple(x) for x in by[1].read_turns] == [("user", odd), ("assistant", odd)] and by[1].loss_text == odd
    assert by[1].layout == "messages" and by[4].loss_text == "7"
    assert [tuple(x) for x in by[3].read_turns] == [("a>\nb\\", "")]
    assert [tuple(x) for x in by[4].turns] == [("user", "i"), ("assistant", "7")]
    assert by[7].turns is None and by[8].formatted is None and by[9].layout is None
    assert by[10].turns == [] and by[10].formatted == ""
    start, end = by[2].loss_spans[0]
    assert by[2].formatted[start:end] == "c" and sha(by[2].loss_text) == sha("c")


def test_chat_roles_parts_and_further_fields(spark):
    records = [
        '{"id": 7, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "weight": 1}]}',
        '{"messages": [{"role": "user", "name": "n", "content": "q"}, {"role": "assistant", "content": "a"}], "meta": {"k": [1]}}',
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "image"}]}, {"role": "assistant", "content": "a"}]}',
        '{"messages": [{"role": "user", "content": ["q", ""]}, {"role": "assistant", "content": [{"text": "a"}]}]}',
        '{"instruction": "q", "input": "", "output": "a", "lang, x": {"a`b: <": null}}', '{"instruction": "q", "input": null, "output": "a"}',
        '{"question": "q", "answer": "a", "source": "s"}', '{"id": 1, "messages": []}', '{"messages": "q", "role": 1}', "[1]", "7", "null",
        '{"instruction": "s", "input": "q", "output": "a"}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id bigint, record string")
    df = df.selectExpr("*", *(f"1 as {c}" for c in ("_record", "_print", "_layout", "formatted", "loss_spans", "read_turns", "loss_text")))
    out = chat.parsed(chat.formatted(chat.canonical(df, "record")))
    assert len(set(out.columns)) == len(out.columns)
    got = {r.id: r for r in out.collect()}
    for i in range(7):
        assert [tuple(x) for x in got[i].read_turns] == [("user", "q"), ("assistant", "a")] and got[i].loss_text == "a", records[i]
    assert got[7].turns == [] and all(got[i].turns is None for i in range(8, 12))
    assert [x.role for x in got[12].turns] == ["system", "user", "assistant"] and got[0]._print == 1
    assert chat.parsed(chat.formatted(chat.canonical(df.limit(0), "record"))).count() == 0

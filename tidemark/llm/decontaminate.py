"""Benchmark passages in documents, found by winnowed fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NO_WORD, words

K = 5


def _gram(n: int) -> str:
    return f"xxhash64({', '.join(f'_w[i + {j}]' for j in range(n))})"


def winnowed(df: DataFrame, keep: list[str], span: int) -> DataFrame:
    """Rows (``keep``, ``_short`` 0, ``_p``, ``_h``): the smallest hash of ``K`` words in each window.

    A window is ``span - K + 1`` such hashes, so of any ``span`` words in a row
    one hash is kept, and which one depends on these words alone.
    """
    window = span - K + 1
    least = ", ".join(f"_g[i + {j}]" for j in range(window))
    most = ", ".join(f"get(_m, i - {j})" for j in range(window))
    return (
        df.where(f"size(_w) >= {span}")
        .selectExpr(*keep, f"transform(sequence(0, size(_w) - {K}), i -> {_gram(K)}) as _g")
        .selectExpr(*keep, "_g", f"transform(sequence(0, size(_g) - {window}), i -> least({least})) as _m")
        .selectExpr(
            *keep, "0 as _short",
            f"inline(filter(transform(_g, (h, i) -> if(h = greatest({most}), struct(i as _p, h as _h), null)), "
            "x -> x is not null))",
        )
    )


def fingerprints(df: DataFrame, keep: list[str], span: int, short: list[int]) -> DataFrame:
    """Winnowed fingerprints, and for each length in ``short`` the hash at every place."""
    found = winnowed(df, keep, span)
    for n in short:
        places = f"posexplode(transform(sequence(0, size(_w) - {n}), i -> {_gram(n)})) as (_p, _h)"
        found = found.unionByName(df.where(f"size(_w) >= {n}").selectExpr(*keep, f"{n} as _short", places))
    return found


def item_windows(items: DataFrame, item_id: str, text: str, span: int) -> DataFrame:
    """Rows (``_window``, ``_items``): each distinct window and the items that have it.

    The ids are strings, sorted; a null id is the empty string.
    """
    cut = f"transform(sequence(0, size(_w) - {span}), i -> array_join(slice(_w, i + 1, {span}), ' '))"
    return (
        items.selectExpr(f"coalesce(cast(`{item_id}` as string), '') as _item", f"{words(text, NO_WORD)} as _w")
        .where("size(_w) > 0")
        .selectExpr("_item", f"explode(if(size(_w) < {span}, array(array_join(_w, ' ')), {cut})) as _window")
        .groupBy("_window")
        .agg(F.expr("sort_array(collect_set(_item)) as _items"))
    )


def hits(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = 10,
) -> DataFrame:
    """Rows (``_text``, ``spans``, ``items``): hit spans and items of each distinct text with any.

    ``_text`` is the MD5 of the text.  Every window of ``span`` item words that
    a text has is found: fingerprints of both are joined, and each hit is
    extended to the windows around it, which are compared as whole strings.
    Items of fewer words are one window.  Spans are ``s`` and ``e``, in words,
    end exclusive, one per window found.
    """
    item_words = items.selectExpr(f"{words(item_text, NO_WORD)} as _w")
    short = sorted(r[0] for r in item_words.selectExpr("size(_w)").where(f"size(_w) between 1 and {span - 1}").distinct().collect())
    wanted = fingerprints(item_words.where(f"size(_w) >= {span}"), [], span, [])
    for n in short:
        whole = item_words.where(f"size(_w) = {n}").selectExpr(f"{n} as _short", "0 as _p", "xxhash64(_w) as _h")
        wanted = wanted.unionByName(whole)
    wanted = wanted.select("_short", "_h").distinct()
    with_words = docs.selectExpr(f"md5(coalesce(`{text}`, '')) as _text", f"{words(f'`{text}`', NO_WORD)} as _w")
    places = (
        fingerprints(with_words, ["_text"], span, short)
        .join(wanted, ["_short", "_h"], "left_semi")
        .groupBy("_text")
        .agg(F.expr("collect_set(struct(_short, _p)) as _places"))
    )
    around = (
        f"array_distinct(flatten(transform(_places, x -> if(x._short > 0, array(struct(x._p as s, x._p + x._short as e)), "
        f"transform(sequence(greatest(0, x._p - {span - K}), least(x._p, size(_w) - {span})), "
        f"s -> struct(s as s, s + {span} as e))))))"
    )
    return (
        with_words.join(places, "_text")
        .selectExpr("_text", "_w", f"{around} as _spans")
        .selectExpr(
            "_text",
            "inline(transform(_spans, x -> struct(x as _at, array_join(slice(_w, x.s + 1, x.e - x.s), ' ') as _window)))",
        )
        .join(item_windows(items, item_id, item_text, span), "_window")
        .groupBy("_text")
        .agg(
            F.expr("sort_array(collect_set(_at)) as spans"),
            F.expr("array_sort(array_distinct(flatten(collect_set(_items)))) as items"),
        )
    )


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``spans``, ``items`` and ``contaminated`` to all rows of ``docs``.

    A null text has no words.  Copies share one search.  Without items nothing
    is hit.  Columns of ``docs`` with these names are replaced.
    """
    covered = (
        "aggregate(coalesce(spans, array()), struct(0L as n, 0 as upto), (a, x) -> struct("
        "a.n + greatest(0, x.e - greatest(x.s, a.upto)) as n, greatest(a.upto, x.e) as upto)).n"
    )
    rest = [c for c in docs.columns if c not in ("n_words", "n_hit", "spans", "items", "contaminated")]
    keyed = docs.selectExpr(
        *(f"`{c}`" for c in rest), f"md5(coalesce(`{text}`, '')) as _text",
        f"cast(size({words(f'`{text}`', NO_WORD)}) as bigint) as n_words",
    )
    return (
        keyed.join(hits(docs, items, text, **names), "_text", "left")
        .selectExpr(
            *(f"`{c}`" for c in rest), "n_words", f"{covered} as n_hit", "spans", "coalesce(items, array()) as items",
        )
        .selectExpr("*", "n_hit > 0 as contaminated")
    )

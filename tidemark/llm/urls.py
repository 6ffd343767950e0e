"""URL verdicts from rules and from a tree of path templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import saved
from .text import lowered

# Two-sided 5 % point of the normal distribution.
SIMILAR_Z = 1.96


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty for null and without ``://``."""
    rest = f"if(coalesce(locate('://', `{url}`), 0) = 0, '', substr(`{url}`, locate('://', `{url}`) + 3))"
    parts = df.drop("host", "path").selectExpr("*", f"{rest} as _rest")
    parts = parts.selectExpr("*", "regexp_extract(_rest, '^[^/?#]*', 0) as _host")
    path = "regexp_extract(substr(_rest, length(_host) + 1), '^[^?#]*', 0)"
    return parts.selectExpr("*", f"{lowered('_host')} as host", f"{path} as path").drop("_rest", "_host")


def rule_for(rules: dict[str, str]) -> str:
    """SQL for the longest of the rules ``host/path`` that fits ``host`` and ``path``, or null.

    A rule fits its host and all subdomains, and paths that start with its own.
    """
    fitting = "cast(null as string)"
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        host, _, path = rule.partition("/")
        fits = f"(host = '{host}' or endswith(host, '.{host}')) and startswith(path, '/{path}')"
        fitting = f"if({fits}, '{rule}', {fitting})"
    return fitting


SHAPE = "regexp_replace(regexp_replace(path, '(?i)[0-9a-f]{16,}', '%'), '[0-9]+', '#')"


def differs(part: str, whole: str, min_labelled: int) -> str:
    """SQL: whether a part's share of bad labels differs from that of the rest, by a test of two proportions."""
    n, bad, all_n, all_bad = f"{part}_labelled", f"{part}_bad", f"{whole}_labelled", f"{whole}_bad"
    rest, share = f"({all_n} - {n})", f"({all_bad} / {all_n})"
    z = f"abs({bad} / {n} - ({all_bad} - {bad}) / {rest}) / sqrt({share} * (1 - {share}) * (1 / {n} + 1 / {rest}))"
    return (
        f"case when {n} < {min_labelled} or {rest} < {min_labelled} or {all_bad} in (0, {all_n}) then false "
        f"else {z} > {SIMILAR_Z} end"
    )


def sums(prefix: str = "") -> list:
    return [F.expr(f"sum({c}) as {prefix}{c}") for c in ("_labelled", "_bad")]


def grown(leaves: DataFrame, min_labelled: int) -> DataFrame:
    """Leaves with their ``_segment`` named ``_out``, given the settled template ``_above`` it.

    Children of one template are pooled, wherever in the literal tree they
    stand.  A child goes into ``*`` unless it differs from its siblings
    together.  Of those that differ, the worse and the better ones are two
    classes; a child that does not differ from the rest of its class, if there
    is one, goes into ``*worse`` or ``*better``, and else keeps its name.
    """
    children = leaves.groupBy("host", "_above", "_segment").agg(*sums())
    above = leaves.groupBy("host", "_above").agg(*sums("_p"))
    told = children.join(above, ["host", "_above"]).selectExpr(
        "*",
        f"case when not ({differs('', '_p', min_labelled)}) then '*' "
        "when _bad / _labelled > _p_bad / _p_labelled then '*worse' else '*better' end as _class",
    )
    classes = told.where("_class <> '*'").groupBy("host", "_above", "_class").agg(*sums("_c"), F.expr("count(1) as _members"))
    named = told.join(classes, ["host", "_above", "_class"], "left").selectExpr(
        "host", "_above", "_segment",
        f"case when _class = '*' then '*' when _members = 1 or ({differs('', '_c', min_labelled)}) then _segment "
        "else _class end as _out",
    )
    return leaves.join(named, ["host", "_above", "_segment"])


def templates(df: DataFrame, min_labelled: int = 20, prior: float = 10.0) -> DataFrame:
    """One row per host and path shape: its ``template`` and smoothed ``badness``.

    ``df`` has ``host``, ``path`` and ``bad`` (1, 0, or null without a label).
    A shape is a path whose runs of digits are ``#`` and whose runs of 16 or
    more hexadecimal digits are ``%``.  Shapes are counted first, so that what
    follows grows with the distinct shapes and a hot host is many keys.  The
    tree is settled level by level, as ``grown`` says, so that branches below
    merged segments are pooled before they are tested.  Below a template with
    under ``2 * min_labelled`` labels nothing can differ, so all of the rest is
    ``*`` at once; levels are as many as the deepest template with more.
    The badness of a template is its share of bad labels, drawn by ``prior``
    labels' weight to the host's, and that to the share of all.
    """
    shapes = saved(
        df.selectExpr("host", f"{SHAPE} as shape", "bad")
        .groupBy("host", "shape")
        .agg(F.expr("count(bad) as _labelled"), F.expr("coalesce(sum(bad), 0) as _bad"))
        .selectExpr("*", "array_remove(split(shape, '/'), '') as _segments")
    )
    columns = ["host", "shape", "_labelled", "_bad", "_segments", "template"]
    left = "repeat('/*', greatest(size(_segments) - {depth}, 0))"
    settled, open_, depth = [], shapes.selectExpr("*", "'' as template"), 0
    while True:
        # What ends here, or stands below too few labels, is done.
        enough = open_.groupBy("host", "template").agg(F.expr("sum(_labelled) as _enough")).where(f"_enough >= {2 * min_labelled}")
        marked = saved(
            open_.join(enough, ["host", "template"], "left").selectExpr(
                *columns, f"_enough is not null and size(_segments) > {depth} as _open"
            )
        )
        settled.append(
            marked.where("not _open").selectExpr(*columns[:4], f"concat(template, {left.format(depth=depth)}) as template")
        )
        going = marked.where("_open").drop("_open")
        if going.isEmpty():
            break
        level = going.withColumnRenamed("template", "_above").selectExpr("*", f"_segments[{depth}] as _segment")
        open_ = grown(level, min_labelled).selectExpr(*columns[:5], "concat(_above, '/', _out) as template")
        depth += 1
    by_leaf = reduce(DataFrame.union, settled)
    hosts = shapes.groupBy("host").agg(F.expr("sum(_labelled) as _on_host"), F.expr("sum(_bad) as _bad_on_host"))
    overall = shapes.selectExpr("coalesce(sum(_bad) / nullif(sum(_labelled), 0), 0D)").scalar()
    whole = by_leaf.groupBy("host", "template").agg(*sums())
    scored = (
        whole.join(hosts, "host")
        .withColumn("_prior", (F.expr("_bad_on_host") + F.lit(prior) * overall) / (F.expr("_on_host") + F.lit(prior)))
        .selectExpr("host", "template", f"(_bad + {prior}D * _prior) / (_labelled + {prior}D) as badness")
    )
    return by_leaf.select("host", "shape", "template").join(scored, ["host", "template"])


def judge(df: DataFrame, rules: dict[str, str], threshold: float = 0.5, **tree) -> DataFrame:
    """Add ``rule`` and ``verdict`` (allow or block), ``template`` and ``badness``.

    ``df`` has ``host``, ``path`` and ``bad``.  A rule's verdict comes before
    the tree's, which blocks templates of ``threshold`` badness and more.  Rows
    are kept as they are, repeated ones too; an empty host is a host.
    """
    found = templates(df, **tree).withColumnsRenamed({"host": "_host", "shape": "_shape"})
    rule = rule_for(rules)
    verdict = "case" + "".join(f" when rule = '{r}' then '{v}'" for r, v in rules.items())
    return (
        df.drop("rule", "verdict", "template", "badness")
        .selectExpr("*", f"{SHAPE} as _of", f"{rule} as rule")
        .join(found, F.expr("host = _host and _of = _shape"), "left")
        .selectExpr("*", f"{verdict} when badness >= {threshold} then 'block' else 'allow' end as verdict")
        .drop("_of", "_host", "_shape")
    )

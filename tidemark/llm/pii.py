"""Personal data: base patterns, and identifiers found by bootstrapped contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import saved

# Possessive forms of the patterns, linear on long runs: a match can start only
# where a run starts or where the last match ended.
BASE = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(_t, '@')",
        "true",
    ),
    "ip": (
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"_t rlike r'[0-9]\.[0-9]'",
        "forall(split(m, r'\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
    ),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"_t rlike r'[0-9][\x20-]?[0-9]'", None),
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]", r"_t rlike r'\+[0-9]'",
        "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15",
    ),
}
KINDS = list(BASE)
# What bootstrapping may add: a word of four or more characters with a digit or
# an at sign, or neighbouring words of digits without letters as one, less the
# punctuation around it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_DIGITS = r"[^\s\p{L}0-9]*+[0-9][^\s\p{L}]*+(?!\S)"
RUN = rf"(?<!\S){_DIGITS}(?: {_DIGITS})++"
# A context is the word next to a span, or the part of it within so many characters.
CONTEXT = 64
FOUND = "array<struct<kind: int, s: int, e: int, m: string, left: string, right: string>>"
SIDES = {"l": "<", "r": ">"}
# More patterns than this are joined by a shuffle and not broadcast.
FEW_PATTERNS = 200_000


def _luhn(m: str) -> str:
    d = f"regexp_replace({m}, '[^0-9]', '')"
    digit = f"cast(substr({d}, -i, 1) as int)"
    double = f"if({digit} > 4, 2 * {digit} - 9, 2 * {digit})"
    total = f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, {digit}, {double}))"
    return f"if(length({d}) between 13 and 19, {total} % 10 = 0, false)"


def located(pattern: str, kind: int) -> str:
    """SQL for all matches in ``_t``: kind, start, end, value and the words to its left and right.

    Matches and the pieces between them come from the same left-to-right search,
    so lengths add up to places.  What is left of a match is carried along, so
    that its word may hold earlier matches; what is right of it is read on over
    the next one.
    """
    ends = f"transform(split(_t, r'{pattern}', -1), p -> struct(length(p) as n, right(p, {CONTEXT}) as tail, left(p, {CONTEXT}) as head))"
    after = (
        f"concat(get(a.ps, i + 1).head, if(get(a.ps, i + 1).n > {CONTEXT}, '', "
        f"concat(left(coalesce(get(a.ms, i + 1), ''), {CONTEXT}), coalesce(get(a.ps, i + 2).head, ''))))"
    )
    matches = (
        f"transform(array(struct(regexp_extract_all(_t, r'{pattern}', 0) as ms, {ends} as ps)), "
        f"a -> transform(a.ms, (m, i) -> struct(m as m, a.ps[i].n as n, a.ps[i].tail as tail, {after} as after)))[0]"
    )
    left = f"right(concat(a.tail, x.tail), {CONTEXT})"
    one = (
        f"struct({kind} as kind, a.at + x.n as s, a.at + x.n + length(x.m) as e, x.m as m, "
        rf"lower(element_at(split(rtrim(' \n\t\r', {left}), r'\s+'), -1)) as left, "
        rf"lower(split(ltrim(' \n\t\r', left(x.after, {CONTEXT})), r'\s+')[0]) as right)"
    )
    step = (
        f"struct(a.at + x.n + length(x.m) as at, right(concat({left}, x.m), {CONTEXT}) as tail, array_append(a.out, {one}) as out)"
    )
    return f"aggregate({matches}, struct(0 as at, '' as tail, cast(array() as {FOUND}) as out), (a, x) -> {step}).out"


def scanned(df: DataFrame) -> DataFrame:
    """``_in`` and, from ``_t``, ``base`` (accepted spans of all kinds, in order) and ``cands`` (what may be identifiers)."""
    none = f"cast(array() as {FOUND})"
    found = df
    for kind, (name, (pattern, guard, test)) in enumerate(BASE.items()):
        good = _luhn("x.m") if test is None else test.replace("(m,", "(x.m,").replace("split(m", "split(x.m")
        found = found.selectExpr("*", f"if({guard}, {located(pattern, kind)}, {none}) as _raw{kind}")
        found = found.selectExpr("*", f"filter(_raw{kind}, x -> {good}) as _is{kind}").drop(f"_raw{kind}")
    spans = ", ".join(f"_is{k}" for k in range(len(BASE)))
    # The punctuation around a word belongs to its context.
    trim = r"regexp_extract(x.m, r'^[^A-Za-z0-9@]*', 0)"
    cand = f"struct(x.s + length({trim}) as s, {core('x.m')} as m, x.left as left, x.right as right)"
    cands = "array<struct<s: int, m: string, left: string, right: string>>"
    found = (
        found.selectExpr("*", f"concat({spans}) as base")
        .selectExpr(
            "*",
            rf"if(_t rlike '[0-9@]', transform({located(CANDIDATE, -1)}, x -> {cand}), cast(array() as {cands})) as _words",
            rf"if(_t rlike '[0-9]' and contains(_t, ' '), transform({located(RUN, -1)}, x -> {cand}), cast(array() as {cands})) as _runs",
        )
        .selectExpr(
            "*",
            "filter(concat(_words, _runs), c -> length(c.m) >= 4 and "
            "not exists(base, b -> b.s < c.s + length(c.m) and c.s < b.e)) as cands",
        )
    )
    return found.select("_in", "base", "cands")


def core(m: str) -> str:
    """SQL for a value without the punctuation around it; a seed and a candidate that differ in no more are one."""
    return rf"regexp_replace({m}, r'^[^A-Za-z0-9@]++|(?<![^A-Za-z0-9])[^A-Za-z0-9]++$', '')"


def contexts() -> str:
    """SQL for the contexts of an occurrence, ``< word`` on its left and ``> word`` on its right."""
    return "filter(array(if(left <> '', concat('< ', left), null), if(right <> '', concat('> ', right), null)), c -> c is not null)"


def bootstrap(
    seeds: DataFrame, cands: DataFrame, rounds: int = 10, min_support: int = 3, confidence: float = 0.7
) -> tuple[DataFrame, DataFrame]:
    """Patterns (``ctx``, ``p0``...) and identifiers (``m``, ``i0``...) with a score for each kind.

    ``seeds`` has ``kind``, ``m``, ``left``, ``right``; ``cands`` the last three.
    The graph has an edge for each context and distinct value next to it.  A
    value counts for a kind if it is a seed of it anywhere, or known from other
    contexts: on one side, at least half of the others are patterns.  So no
    pattern supports itself.  A context's score is the number that counts, over
    this, those that count for other kinds, half of the rest, and one.  It
    becomes a pattern with ``min_support`` and a score of ``confidence``.  Both
    sets only grow; rounds end when no pattern is added, or after ``rounds``.
    A candidate is an identifier with score 1 if it is a seed elsewhere; else if
    on one side half of its contexts are patterns, and its score is one less
    the product of their doubts.
    """
    kinds = range(len(BASE))
    # Counts are combined before the shuffle; a frequent context is many (ctx, m) rows.
    # The empty context holds every value once, also those without any context.
    both = seeds.selectExpr("left", "right", f"{core('m')} as m", "kind").unionByName(
        cands.selectExpr("left", "right", "m", "-1 as kind")
    )
    edges = saved(
        both.selectExpr(f"explode(array_append({contexts()}, '')) as ctx", "m", "kind")
        .groupBy("ctx", "m")
        .agg(*(F.expr(f"max(if(kind = {k}, 1, 0)) as seed{k}") for k in kinds), F.expr("max(if(kind < 0, 1, 0)) as cand"))
    )
    patterns = edges.select("ctx", *(F.lit(0.0).alias(f"p{k}") for k in kinds)).limit(0)
    known = 0
    for _ in range(rounds):
        told = with_patterns(edges, patterns, known)
        knows = {
            k: " or ".join(
                f"if(startswith(ctx, '{side}'), {name}{k} > own{k} and 2 * ({name}{k} - own{k}) >= n_{name} - 1, "
                f"{name}{k} > 0 and 2 * {name}{k} >= n_{name})"
                for name, side in SIDES.items()
            )
            for k in kinds
        }
        own = told.where("ctx <> ''").selectExpr("ctx", "m", *(f"if(p{k} > 0, 1, 0) as own{k}" for k in kinds))
        counted = own.join(told.groupBy("m").agg(*votes()), "m").selectExpr(
            "ctx", *(f"if(seed{k} = 1 or {knows[k]}, 1, 0) as c{k}" for k in kinds)
        )
        any_kind = " + ".join(f"c{k}" for k in kinds)
        sums = counted.groupBy("ctx").agg(
            *(F.expr(f"sum(c{k}) as c{k}") for k in kinds),
            *(F.expr(f"sum(if(c{k} = 0 and {any_kind} > 0, 1, 0)) as o{k}") for k in kinds),
            F.expr("count(1) as n"),
        )
        score = {k: f"c{k} / (c{k} + o{k} + (n - c{k} - o{k}) / 2 + 1)" for k in kinds}
        patterns = saved(
            sums.selectExpr(
                "ctx", *(f"if(c{k} >= {min_support} and {score[k]} >= {confidence}, {score[k]}, 0D) as p{k}" for k in kinds)
            ).where(" or ".join(f"p{k} > 0" for k in kinds))
        )
        before, known = known, patterns.count()
        if known == before:
            break
    half = {k: " or ".join(f"({n}{k} > 0 and 2 * {n}{k} >= n_{n})" for n in SIDES) for k in kinds}
    doubts = (F.expr(f"1 - exp(sum(ln(1 - least(p{k}, 0.999999D)))) as i{k}") for k in kinds)
    identifiers = (
        with_patterns(edges, patterns, known)
        .groupBy("m")
        .agg(*votes(), *doubts)
        .where("cand = 1")
        .selectExpr("m", *(f"case when seed{k} = 1 then 1D when {half[k]} then i{k} else 0D end as i{k}" for k in kinds))
        .where(" or ".join(f"i{k} > 0" for k in kinds))
    )
    return few(patterns, known), identifiers


def votes() -> list:
    """Of a value: what it is known as, its contexts on each side, and those that are patterns of each kind."""
    kinds = range(len(BASE))
    return [
        *(F.expr(f"max({c}) as {c}") for c in ["cand", *(f"seed{k}" for k in kinds)]),
        *(F.expr(f"count_if(startswith(ctx, '{side}')) as n_{name}") for name, side in SIDES.items()),
        *(
            F.expr(f"count_if(p{k} > 0 and startswith(ctx, '{side}')) as {name}{k}")
            for name, side in SIDES.items() for k in kinds
        ),
    ]


def few(patterns: DataFrame, n: int) -> DataFrame:
    """Patterns, broadcast if they are few: a context of 64 characters and four numbers each."""
    return F.broadcast(patterns) if n <= FEW_PATTERNS else patterns


def with_patterns(edges: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    scores = [f"p{k}" for k in range(len(BASE))]
    return edges.join(few(patterns, n), "ctx", "left").na.fill(0.0, scores)


def find(df: DataFrame, text: str = "text", keep_text: bool = False, **how) -> DataFrame:
    """Add ``base`` and ``added`` to every row: spans (kind, s, e) in code points, end exclusive.

    ``base`` holds the leftmost non-overlapping matches of each kind that pass
    its test; ``added`` what bootstrapping found, never overlapping a base span
    nor each other: candidates next to a pattern, and identifiers wherever they
    stand.  A null text has no spans.  Each row keeps its own, repeated rows and
    repeated keys too.  Columns named ``base`` and ``added`` are replaced, all
    others kept.  ``df`` is scanned once, and the columns and spans are saved;
    the text is among them only with ``keep_text``.
    """
    kept = [c for c in df.columns if c not in ("base", "added") and (keep_text or c != text)]
    columns = "".join(f", '{c}', `{c}`" for c in kept)
    packed = df.selectExpr(f"named_struct('_', 0{columns}) as _in", f"coalesce(`{text}`, '') as _t")
    rows = saved(scanned(packed).selectExpr("*", "monotonically_increasing_id() as _row"))
    base = rows.selectExpr("inline(base)")
    cand = rows.where("size(cands) > 0").selectExpr("_row", "inline(cands)")
    patterns, identifiers = bootstrap(base, cand, **how)
    kinds = range(len(BASE))
    near = cand.selectExpr("_row", "s", "m", f"explode_outer({contexts()}) as ctx").join(patterns, "ctx", "left").join(identifiers, "m", "left")
    scores = ", ".join(f"struct(coalesce(greatest(p{k}, i{k}), 0D) as score, -{k} as k)" for k in kinds)
    told = near.selectExpr("_row", "s", "m", f"array_max(array({scores})) as _best").where("_best.score > 0")
    # One row an occurrence again, by its better side; of overlapping ones the leftmost, then longest.
    spans = "sort_array(collect_list(struct(s, -(s + length(m)) as e, _best.k as k)))"
    step = (
        "if(x.s < a.upto, a, struct(-x.e as upto, array_append(a.out, struct(-x.k as kind, x.s as s, -x.e as e)) as out))"
    )
    none = "cast(array() as array<struct<kind: int, s: int, e: int>>)"
    added = (
        told.groupBy("_row", "s", "m").agg(F.expr("max(_best) as _best"))
        .groupBy("_row").agg(F.expr(spans).alias("_spans"))
        .selectExpr("_row", f"aggregate(_spans, struct(0 as upto, {none} as out), (a, x) -> {step}).out as added")
    )
    slim = "transform(base, x -> struct(x.kind, x.s, x.e))"
    return rows.join(added, "_row", "left").selectExpr(
        *(f"_in.`{c}`" for c in kept), f"{slim} as base", f"coalesce(added, {none}) as added"
    )


def named(spans: str) -> str:
    """SQL for ``kind:start:end`` of sorted spans, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.kind], x.s, x.e)), ',')"


def masked(text: str, spans: str) -> str:
    """SQL for the text with each of ``spans`` (overlapping ones as one) replaced by ``<kind>``."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    order = f"sort_array(transform({spans}, x -> struct(x.s as s, x.e as e, x.kind as kind)))"
    step = (
        "if(x.s < a.upto, struct(a.out as out, greatest(a.upto, x.e) as upto), struct("
        f"concat(a.out, substr({text}, a.upto + 1, x.s - a.upto), '<', array({names})[x.kind], '>') as out, x.e as upto))"
    )
    folded = f"aggregate({order}, struct('' as out, 0 as upto), (a, x) -> {step}, a -> concat(a.out, substr({text}, a.upto + 1)))"
    return f"if(size({spans}) = 0, {text}, {folded})"

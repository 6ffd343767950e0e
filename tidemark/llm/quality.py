"""Text quality from overlapping heuristics, without hand-made labels.

Heuristic labellers vote good, bad or nothing.  Expectation-maximisation
estimates how often each is right, and the posteriors train a linear scorer
over hashed word shapes, which then judges every text.  Shapes say nothing of
abuse, so toxic texts are found apart, by a list of words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Each labeller: bad if the first condition holds, good if the second, else no vote.
LABELLERS = {
    "symbols": ("symbols > 0.4D * n", "symbols < 0.1D * n"),
    "shouting": ("capitals > 0.5D * letters", "capitals < 0.3D * letters"),
    "echo": ("echoes > 0.15D * n", "echoes < 0.05D * n"),
    "variety": ("kinds < 0.35D * n", "kinds > 0.6D * n"),
    "lines": ("repeated_lines > 0.3D * n_lines", "repeated_lines < 0.1D * n_lines"),
    "wordless": ("wordless > 0.2D * n", "wordless < 0.05D * n"),
    "marks": ("marked > 0.5D * n", "marked < 0.25D * n"),
    "sentences": ("n > 40 and stops = 0", "stops between 0.01D * n and 0.3D * n"),
}
BUCKETS, MOST_TRAINED = 1 << 12, 10_000

# Abusive words by language, as regular expressions for letters of a
# lower-cased word between other marks; each list is looked for in texts of every language.  Other
# words are not found, such as the invented ones of the given tables in de, fr and es.
ABUSE = {
    "en": r"idiots?|morons?|scum|worthless|stupid|losers?|pathetic|disgusting|trash|clowns?|imbeciles?|retards?|retarded|"
    r"bastards?|bitch(?:es)?|assholes?|dumbass(?:es)?|whores?|sluts?|cunts?|scumbags?|motherfuckers?",
    "de": r"idioten?|idiotin(?:nen)?|trottel|arschl(?:och|öcher)|abschaum|dummk(?:opf|öpfe)|hurens(?:ohn|öhne)|schlampen?|wichser|"
    r"missgeburt(?:en)?|drecksau|wertlos(?:e|er|es|en)?",
    "fr": r"connards?|connasses?|salopes?|salauds?|putes?|imbéciles?|crétine?s?|abrutie?s?|enculés?|idiote?s?|ordures?|débiles?",
    "es": r"idiotas?|imb[eé]cil(?:es)?|estúpid[oa]s?|gilipollas|putas?|cabr(?:ón|ones)|escoria|pendej[oa]s?|inútil(?:es)?|asqueros[oa]s?",
}
# A text is toxic if so large a share of its words are abusive, or so many stand within so many words.
ABUSIVE_SHARE, ABUSIVE_WORDS, ABUSIVE_WITHIN = 0.01, 4, 400


def measured(df: DataFrame, text: str) -> DataFrame:
    """Add ``shapes`` (a token for each word's shape), ``votes`` (-1, 0, 1 for each labeller) and ``toxic``.

    Letters in a row become ``a`` or ``A``, digits ``0``, other marks stay; a
    word equal to the one before it becomes ``=``.  Words are looked up in
    ``ABUSE`` over the whole text.
    """
    t = f"coalesce(`{text}`, '')"
    cased = rf"regexp_replace(regexp_replace(regexp_replace({t}, r'\p{{Ll}}+', 'a'), r'\p{{Lu}}+', 'A'), r'\p{{N}}+', '0')"
    abuse = rf"r'(?<!\p{{L}})(?:{'|'.join(ABUSE.values())})(?!\p{{L}})'"
    split = df.selectExpr(
        "*", f"array_remove(split({t}, r'[\x20\x09-\x0D]+'), '') as _w", f"split({t}, '\n') as _lines", f"{cased} as _c",
    )
    # Distinct words of each block of 400, added up, so that long texts are not judged poor for their length.
    kinds = "aggregate(sequence(0, greatest(0, size(_w) - 1), 400), 0, (a, i) -> a + size(array_distinct(slice(_w, i + 1, 400))))"
    # What is counted by runs of letters is counted in the short text of shapes.
    counted = split.selectExpr(
        *(f"`{c}`" for c in df.columns), "size(_w) as n", "size(_lines) as n_lines",
        "size(_lines) - size(array_distinct(_lines)) as repeated_lines",
        f"{kinds} as kinds", "length(_c) - length(replace(_c, 'A', '')) as capitals",
        "length(_c) - length(replace(replace(_c, 'A', ''), 'a', '')) as letters",
        r"length(regexp_replace(_c, r'[aA0\s.,;:\x27\x22()-]+', '')) as symbols",
        r"regexp_count(_c, r'(?<!\S)[^aA\s]++(?!\S)') as wordless",
        r"regexp_count(_c, r'(?<!\S)[aA0]*+[^aA0\s]\S*+') as marked", r"regexp_count(_c, r'[.?!](?!\S)') as stops",
        "transform(array_remove(split(_c, r'[\\x20\\x09-\\x0D]+'), ''), (s, i) -> "
        "if(i > 0 and _w[i] = _w[i - 1], '=', s)) as shapes",
        f"if(lower({t}) rlike {abuse}, filter(transform(_w, (w, i) -> if(lower(w) rlike {abuse}, i, null)), "
        "i -> i is not null), array()) as abusive",
    ).selectExpr("*", "size(filter(shapes, s -> s = '=')) as echoes")
    toxic = (
        f"size(abusive) > 0 and (size(abusive) >= {ABUSIVE_SHARE}D * n or exists(transform(abusive, (p, i) -> "
        f"get(abusive, i + {ABUSIVE_WORDS - 1}) - p), d -> coalesce(d < {ABUSIVE_WITHIN}, false)))"
    )
    vote = ", ".join(f"case when n = 0 then 0 when {bad} then -1 when {good} then 1 else 0 end" for bad, good in LABELLERS.values())
    kept = [c for c in df.columns if c not in ("shapes", "votes", "toxic")]
    return counted.selectExpr(*(f"`{c}`" for c in kept), "shapes", f"array({vote}) as votes", f"{toxic} as toxic")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, np.ndarray]:
    """Share of good texts and each labeller's chance of each vote if it votes, by expectation-maximisation.

    ``patterns`` are distinct vote tuples and counts, at most three to the
    number of labellers whatever the corpus.  The chances have the shape
    (labeller, class bad or good, vote).  It starts from the majority of votes.
    """
    votes = np.array([p for p, _ in patterns], int) + 1
    counts = np.array([c for _, c in patterns], float)
    seen = np.eye(3)[votes]
    good = np.clip(0.5 + 0.45 * np.sign((votes - 1).sum(axis=1) - 0.5), 0.05, 0.95)
    # A labeller that says bad is seldom heard on good texts: pull towards bad if any does.
    good = np.where((votes == 0).any(axis=1), np.minimum(good, 0.4), good)
    for _ in range(rounds):
        by_class = np.stack([1 - good, good]) * counts
        prior = (by_class[1].sum() + 1) / (counts.sum() + 2)
        chances = np.einsum("cp,plv->lcv", by_class, seen) + 0.5
        chances /= chances[:, :, [0, 2]].sum(axis=2, keepdims=True)
        chances[:, :, 1] = 1  # no vote says nothing
        good = posterior(votes - 1, prior, chances)
    return float(prior), chances


def posterior(votes: np.ndarray, prior: float, chances: np.ndarray) -> np.ndarray:
    at = np.arange(votes.shape[1])
    log = np.log(chances[at, :, votes + 1]).sum(axis=1) + np.log([1 - prior, prior])
    return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def posterior_sql(prior: float, chances: np.ndarray) -> str:
    """SQL for the posterior of ``votes``."""
    ratio = np.log(chances[:, 1, :] / chances[:, 0, :])
    parts = (
        f"element_at(array({', '.join(f'{x!r}D' for x in row.tolist())}), votes[{i}] + 2)" for i, row in enumerate(ratio)
    )
    return f"(1 / (1 + exp(-({float(np.log(prior / (1 - prior)))!r}D + {' + '.join(parts)}))))"


def scored(weights: np.ndarray, bias: float) -> str:
    """SQL for the scorer's chance of a good text: its words' weights by hashed shape, averaged."""
    array = f"array({', '.join(f'{w!r}D' for w in weights.tolist())})"
    total = f"aggregate(shapes, 0D, (a, s) -> a + {array}[pmod(hash(s), {len(weights)})])"
    return f"1 / (1 + exp(-({bias!r}D + {total} / greatest(1, size(shapes)))))"


def trained(rows: np.ndarray, cells: np.ndarray, shares: np.ndarray, good: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels, by full-batch Adam.

    ``rows``, ``cells`` and ``shares`` say how much of which text lies in which
    hash cell.  Cells are scaled to equal spread, and weights back.
    """
    n = max(1, len(good))
    spread = np.sqrt(np.bincount(cells, shares**2, BUCKETS) / n) + 1e-3
    x = shares / spread[cells]
    w, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    for step in range(1, rounds + 1):
        guess = 1 / (1 + np.exp(-np.clip(np.bincount(rows, x * w[cells], n) + w[-1], -50, 50)))
        error = (guess - good) / n
        slope = np.append(np.bincount(cells, x * error[rows], BUCKETS), error.sum()) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1] / spread, float(w[-1])


def fit(df: DataFrame, text: str, most_trained: int = MOST_TRAINED) -> tuple[str, str]:
    """SQL of the scorer and of the posterior that taught it.

    The labellers are estimated over all texts.  The scorer is fitted on
    ``most_trained`` distinct texts at most, a bound of the training and not of
    the judging, taken in the order of their hashes; of each the driver gets
    counts by hash cell, once however often the text occurs.
    """
    patterns = measured(df, text).groupBy("votes").agg(F.expr("count(1) as c")).collect()
    total = sum(r.c for r in patterns)
    if not total:
        return "0.5D", "0.5D"
    teacher = posterior_sql(*estimate([(tuple(r.votes), r.c) for r in patterns]))
    hashed = df.selectExpr(f"`{text}`", f"xxhash64(`{text}`) as _hash")
    some = hashed.where(f"pmod(_hash, {max(1, -(-total // max(1, most_trained)))}) = 0")
    last = some.select("_hash").distinct().orderBy("_hash").limit(most_trained).selectExpr("max(_hash)").first()[0]
    taken = some.where(f"_hash <= {last}").dropDuplicates(["_hash"]) if last is not None else some
    counts = (
        measured(taken.select(text), text)
        .selectExpr(
            "monotonically_increasing_id() as row", f"{teacher} as good", "size(shapes) as n",
            f"transform(shapes, s -> pmod(hash(s), {BUCKETS})) as cells",
        )
        .selectExpr("row", "good", "n", "explode(cells) as cell")
        .groupBy("row", "good", "n", "cell").agg(F.expr("count(1) as c"))
    ).toPandas()
    ids, rows = np.unique(counts["row"].to_numpy(), return_inverse=True)
    good = np.zeros(len(ids))
    good[rows] = counts["good"]
    weights, bias = trained(rows, counts["cell"].to_numpy(int), (counts["c"] / counts["n"]).to_numpy(float), good)
    return scored(weights, bias), teacher


def judged(df: DataFrame, text: str = "text", threshold: float = 0.5, most_trained: int = MOST_TRAINED) -> DataFrame:
    """Add ``votes``, ``posterior``, ``score`` (chance of a good text), ``good`` and ``toxic`` to every row.

    ``good`` is of the prose alone, whatever it says; ``toxic`` is of its words.
    A text without words, null included, scores 0 and is not good.  Repeated
    texts score alike.  Columns of ``df`` with these names are replaced.
    """
    rest = df.drop("votes", "posterior", "score", "good", "toxic", "shapes")
    scorer, teacher = fit(df.select(text), text, most_trained)
    names = [f"`{c}`" for c in rest.columns]
    return (
        measured(rest, text)
        .selectExpr(*names, "votes", "toxic", f"{teacher} as posterior", f"if(size(shapes) = 0, 0D, {scorer}) as score")
        .selectExpr("*", f"score > 0 and score >= {threshold} as good")
    )


def kept(df: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` whose text is good and not toxic.

    A plain filter would be pushed below the words and shapes and repeat them
    for each word, so the rows are listed by a generator instead.
    """
    columns = ", ".join(f"`{c}`" for c in df.columns)
    return judged(df, text, **how).selectExpr(f"inline(if(good and not toxic, array(struct({columns})), null))")

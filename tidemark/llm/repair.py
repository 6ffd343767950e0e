"""Cheapest repair of conversations, by min-plus matrices of a shared grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import skew_join

from .job import saved, ship

ship(__name__)

# What an edit costs.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
# A row is one symbol: the initial of its role, capital if its text is cut off, or MUST if it has to go.
MUST, OTHER = "x", "o"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
CHUNK_ROWS, CHUNK_LETTERS = 1024, 1 << 20
ROWS_AT_ONCE = 500
ROUNDS, PAIRS_EACH, MOST_LISTED = 5, 8, 64
SPACE = r"\x20\x09-\x0D"

# A rope is text, or two ropes one after the other; a weight is its cost and the rope of its edits.
Rope = str | tuple
Weight = tuple[int, Rope]
Matrix = list[list[Weight | None]]


def flat(rope: Rope) -> str:
    """The text of a rope."""
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += [r[1], r[0]]
    return "".join(out)


def less(a: Weight, b: Weight) -> bool:
    """Cheaper, or as cheap with the lesser edits.

    Edits for the same rows with the same cost are never one the beginning of
    the other, for a further insertion costs more; so what is less stays less
    whatever comes before or after it.
    """
    return a[0] < b[0] or (a[0] == b[0] and flat(a[1]) < flat(b[1]))


def times(a: Matrix, b: Matrix) -> Matrix:
    """One after the other: of all states between, the least weight."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        for k in STATES:
            if (x := a[i][k]) is None:
                continue
            for j in STATES:
                if (y := b[k][j]) is None:
                    continue
                w = (x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1])
                if out[i][j] is None or less(w, out[i][j]):
                    out[i][j] = w
    return out


def after(state: int, role: str) -> int | None:
    """The state after a row with this role, or none if it may not follow."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "a":
        return ASSISTANT if state == USER else None
    return USER if role == "u" and state != USER else None


def inserted() -> Matrix:
    """No insertion or some; each costs, so a state is never visited twice."""
    out: Matrix = [[(0, "") if i == j else None for j in STATES] for i in STATES]
    for i in STATES:
        state, edits = i, ""
        while True:
            state, edits = (ASSISTANT if state == USER else USER), edits + "I"
            if out[i][state] is not None:
                break
            out[i][state] = (INSERT * len(edits), edits)
    return out


def one_row(symbol: str) -> Matrix:
    """Weights of a single row, with what is inserted before it."""
    step: Matrix = [[(DELETE, "D") if i == j else None for j in STATES] for i in STATES]
    if symbol != MUST:
        more = CUT_OFF if symbol.isupper() else 0
        for i in STATES:
            moves = [(after(i, symbol.lower()), KEEP, "K"), (after(i, "u"), REROLE, "R"), (after(i, "a"), REROLE, "R")]
            for j, cost, edit in moves:
                w = (cost + more, edit)
                if j is not None and (step[i][j] is None or less(w, step[i][j])):
                    step[i][j] = w
    return times(inserted(), step)


class Grammar:
    """Pairs of symbols that stand for one, each with its matrix, made bottom-up from those of its parts."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.matrices = {s: one_row(s) for s in (MUST, *"suao", *"SUAO")}
        for name, (a, b) in rules:
            self.matrices[name] = times(self.matrices[a], self.matrices[b])
        self.of = lru_cache(10_000)(self.product)

    def __reduce__(self):
        return Grammar, (self.rules,)

    def packed(self, symbols: str) -> str:
        for name, pair in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def product(self, symbols: str) -> list[list[tuple[int, str] | None]]:
        """The matrix of some rows, with the edits as text; known for symbols that came before."""
        first, *others = self.packed(symbols)
        out = self.matrices[first]
        for s in others:
            out = times(out, self.matrices[s])
        return [[w and (w[0], flat(w[1])) for w in row] for row in out]


def grammar(symbols: DataFrame) -> Grammar:
    """Re-Pair over a column ``symbols`` of all chunks, each distinct one weighted by its number.

    In each of ``ROUNDS`` rounds the pairs are counted in Spark and the most
    frequent ones that share no symbol become rules, ``PAIRS_EACH`` at most.
    The driver sees the rules and ``MOST_LISTED`` counts a round.  Which rules
    there are changes the work only, never a result.
    """
    kinds = saved(symbols.groupBy("symbols").agg(F.expr("count(1) as n")))
    rules: list[tuple[str, str]] = []
    packed = "symbols"
    for _ in range(ROUNDS):
        pairs = (
            kinds.selectExpr(f"{packed} as s", "n").where("length(s) > 1")
            .selectExpr("explode(transform(sequence(1, length(s) - 1), i -> substr(s, i, 2))) as pair", "n")
            .groupBy("pair").agg(F.expr("sum(n) as n")).where("n > 1")
        )
        taken: set[str] = set()
        for pair, _n in pairs.orderBy(F.desc("n"), "pair").limit(MOST_LISTED).collect():
            if len(taken) < 2 * PAIRS_EACH and not taken & set(pair):
                name = chr(0xE000 + len(rules))
                rules.append((name, pair))
                packed = f"replace({packed}, '{pair}', '{name}')"
                taken |= set(pair)
        if not taken:
            break
    return Grammar(rules)


CHUNK = (
    "part int, no bigint, symbols string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "turns bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string, "
    "messages array<struct<role: string, text: string>>"
)


def chunks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a conversation as records of bounded size.

    Rows come in order, each with its number of equal ones, of which all but
    the first are duplicates.  Rows that must go leave a symbol only.
    """
    part, no, key = TaskContext.get().partitionId(), 0, object()
    out: list[dict] = []
    now: dict = {}
    letters = 0

    def table() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pylist(out, schema)
        out.clear()
        return rows

    for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
        for row in batch.to_pylist():
            initial, turn, text = row["role"][:1], row["turn"], row["text"]
            left, first = row["copies"], True
            while left:
                if not now or row["conv"] != key or len(now["symbols"]) >= CHUNK_ROWS or letters >= CHUNK_LETTERS:
                    if now:
                        now["symbols"] = "".join(now["symbols"])
                        out.append(now)
                    now = {
                        "conv": row["conv"], "part": part, "no": no, "symbols": [], "blank": 0, "duplicate": 0, "truncated": 0,
                        "illegal": 0, "turns": 0, "first_turn": None, "last_turn": None, "first_initial": initial,
                        "last_initial": None, "messages": [],
                    }
                    no, key, letters = no + 1, row["conv"], 0
                room = min(left, CHUNK_ROWS - len(now["symbols"])) if not first else 1
                fault = row["fault"] if first or row["fault"] == "blank" else "duplicate"
                if fault:
                    now[fault] += room
                if fault in ("blank", "duplicate"):
                    now["symbols"] += [MUST] * room
                else:
                    symbol = initial if initial in ("s", "u", "a") else OTHER
                    now["symbols"].append(symbol.upper() if fault else symbol)
                    now["messages"].append({"role": row["role"], "text": text})
                    letters += len(text)
                if now["last_initial"] is not None:
                    now["illegal"] += now["last_initial"] + initial not in LEGAL
                now["illegal"] += (initial + initial not in LEGAL) * (room - 1)
                now["last_initial"] = initial
                if turn is not None and turn != now["last_turn"]:
                    now["turns"] += 1
                    now["first_turn"] = turn if now["first_turn"] is None else now["first_turn"]
                    now["last_turn"] = turn
                left, first = left - room, False
        yield table()
    if now:
        now["symbols"] = "".join(now["symbols"])
        out.append(now)
    yield table()


SUMS = ("blank", "duplicate", "truncated")
FORWARD = (
    "part int, no bigint, symbols string, before array<int>, last int, ending string, gaps bigint, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)


def ordered(best: dict[int, tuple]) -> dict[int, tuple[int, int, str]]:
    """Each state's cost, rank and open end, short again.

    States whose edits have parted for good get different ranks; those of
    which one's edits are the beginning of another's share a rank and keep
    what follows, which can be insertions only.
    """
    out, rank, head = {}, -1, None
    for state, (cost, at, edits) in sorted(best.items(), key=lambda x: (x[1][1], x[1][2])):
        if head is None or head[0] != at or not edits.startswith(head[1]):
            head, rank = (at, edits), rank + 1
        out[state] = cost, rank, edits[len(head[1]) :]
    return out


def forward(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rules: Grammar) -> Iterator[pa.RecordBatch]:
    """From a conversation's first chunk to its last: the state before each for every state after it.

    One row of four weights is held, and of the edits only what may still
    decide a tie.  The last chunk gets the sums, cost and final state.
    """
    ends = inserted()
    prior: dict | None = None
    state: dict[int, tuple[int, int, str]] = {}
    sums: dict = {}

    def step(row: dict) -> dict:
        nonlocal state, sums
        if prior is None or prior["conv"] != row["conv"]:
            state, sums = {START: (0, 0, "")}, dict.fromkeys((*SUMS, "illegal", "turns"), 0) | {"least": None, "most": None, "initial": None}
        matrix, best, before = rules.of(row["symbols"]), {}, [-1] * 4
        for k, (cost, rank, end) in state.items():
            for j in STATES:
                if (w := matrix[k][j]) is not None:
                    found = (cost + w[0], rank, end + w[1])
                    if j not in best or found < best[j]:
                        best[j], before[j] = found, k
        state = ordered(best)
        for name in (*SUMS, "illegal", "turns"):
            sums[name] += row[name]
        if sums["initial"] is not None:
            sums["illegal"] += sums["initial"] + row["first_initial"] not in LEGAL
        if row["first_turn"] is not None:
            sums["turns"] -= sums["most"] == row["first_turn"]
            sums["least"] = row["first_turn"] if sums["least"] is None else sums["least"]
            sums["most"] = row["last_turn"]
        sums["initial"] = row["last_initial"]
        return {"conv": row["conv"], "part": row["part"], "no": row["no"], "symbols": row["symbols"], "before": before}

    def ended(row: dict) -> dict:
        final = min(
            (cost + w[0], rank, end + w[1], k, w[1])
            for k, (cost, rank, end) in state.items() for j in (START, ASSISTANT) if (w := ends[k][j]) is not None
        )
        gaps = 0 if sums["least"] is None else sums["most"] - sums["least"] + 1 - sums["turns"]
        return row | {n: sums[n] for n in (*SUMS, "illegal")} | {"gaps": gaps, "cost": final[0], "last": final[3], "ending": final[4]}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if prior is not None:
                out.append(ended(prior) if prior["conv"] != row["conv"] else prior)
            prior = step(row)
        yield pa.RecordBatch.from_pylist(out, schema)
    if prior is not None:
        yield pa.RecordBatch.from_pylist([ended(prior)], schema)


def backward(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rules: Grammar) -> Iterator[pa.RecordBatch]:
    """From a conversation's last chunk to its first: each one's edits and the state it starts in."""
    state = START
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["last"] is not None:
                state = row["last"]
            start = row["before"][state]
            edits = rules.of(row["symbols"])[start][state][1] + (row["ending"] or "")
            out.append({"conv": row["conv"], "part": row["part"], "no": row["no"], "start": start, "edits": edits})
            state = start
        yield pa.RecordBatch.from_pylist(out, schema)


def written(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Repaired messages from records in order: a chunk's edits, then the chunk."""
    edits, state = "", START
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["messages"] is None:
                edits, state = row["edits"], row["start"]
                continue
            symbols, messages = iter(row["symbols"]), iter(row["messages"])
            for place, edit in enumerate(edits):
                if edit == "I":
                    role, text = None, ""
                else:
                    message = None if next(symbols) == MUST else next(messages)
                    if edit == "D":
                        continue
                    role, text = message["role"] if edit == "K" else None, message["text"]
                if role is None:
                    state = ASSISTANT if state == USER else USER
                    role = ROLES[state]
                else:
                    state = after(state, role[:1])
                out.append({"conv": row["conv"], "part": row["part"], "no": row["no"], "place": place, "edit": edit, "role": role, "text": text})
        yield pa.RecordBatch.from_pylist(out, schema)


def task(df: DataFrame, run, columns: str, kind: str, **more) -> DataFrame:
    """``run`` over the batches of each task, with its results' schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    told = f"conv {kind}, {columns}"
    schema = to_arrow_schema(_parse_datatype_string(told))
    return df.mapInArrow(partial(run, schema=schema, **more), told)


def repair(
    df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Conversations made well-formed by the cheapest edits: a summary, and the repaired messages.

    The summary has a row for each conversation: ``key``, ``gaps`` (turns
    missing between the first and the last), ``blank``, ``duplicate`` and
    ``truncated`` (rows by first fault), ``illegal`` (neighbours whose roles'
    initials are not su, ua or au), ``cost`` and ``audit``, the initials of the
    edits: Keep, Rerole to user or assistant, Delete (blank and duplicate rows
    must go), Insert.  The messages are ``key``, ``part``, ``no``, ``place``
    (which order them), ``edit``, ``role`` and ``text``; within a task they
    stand in order, conversation after conversation.

    Rows are taken by turn, nulls first, rows of one turn by role and text.  A
    null role or text is one space; a null key is a conversation of its own.
    Each row is a symbol of its role's initial and fault.  Equal rows are
    counted first; a text seen in an earlier turn is found by joining each to
    its first turn, hot ones cut into parts.  Ordered ranges of rows, which cut
    long conversations too, become chunks of up to ``CHUNK_ROWS`` symbols and
    about ``CHUNK_LETTERS`` letters.  Pairs of symbols that are frequent over
    all conversations become rules (``grammar``), each with one matrix of the
    least weights between four states; a chunk's matrix is the product of few
    rules' and is shared by all chunks with its symbols.  Two passes over the
    chunks, forward and back, settle conversations of any length: a task holds
    four weights at a time.  A turn must be a whole number; tables may be
    empty, and further columns are ignored whatever their names.
    """
    kind = df.schema[key].dataType.simpleString()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.selectExpr(
        f"`{key}` as conv", f"cast(`{turn}` as bigint) as turn", f"coalesce(`{role}`, ' ') as role", f"coalesce(`{text}`, ' ') as text"
    ).groupBy("conv", "turn", "role", "text").agg(F.expr("count(1) as copies"))
    # One key that is never null; lengths keep its parts apart.
    name = "coalesce(concat(length(cast(conv as string)), ':', cast(conv as string)), '-')"
    keyed = rows.selectExpr("*", f"md5(concat({name}, ':', length(role), ':', role, text)) as _said")
    firsts = keyed.groupBy("_said").agg(F.expr("min(struct(turn)) as _first"))
    marked = skew_join(keyed, firsts, ["_said"], "inner")
    fault = (
        f"case when not rlike(text, r'[^{SPACE}]') then 'blank' when _first < struct(turn) then 'duplicate' "
        f"when not rlike(text, r'[.!?][{SPACE}]*\\z') then 'truncated' end"
    )
    ready = marked.selectExpr("conv", "turn", "role", "text", "copies", f"{fault} as fault")
    # Beginnings of texts are in the order of the texts, and short enough to be sampled.
    ranged = ready.repartitionByRange(parts, "conv", "turn", "role", F.expr("substr(text, 1, 64)"))
    ranged = ranged.sortWithinPartitions("conv", "turn", "role", "text")
    held = saved(task(ranged, chunks, CHUNK, kind))
    rules = grammar(held.select("symbols"))

    narrow = held.drop("messages").repartition(parts, "conv").sortWithinPartitions("conv", "part", "no")
    ahead = saved(task(narrow, forward, FORWARD, kind, rules=rules))
    back = ahead.select("conv", "part", "no", "symbols", "before", "last", "ending").repartition(parts, "conv")
    back = back.sortWithinPartitions("conv", F.desc("part"), F.desc("no"))
    edits = saved(task(back, backward, "part int, no bigint, start int, edits string", kind, rules=rules))

    audits = edits.groupBy("conv").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(part, no, edits))), e -> e.edits), '') as audit")
    )
    sums = ahead.where("last is not null").select("conv", "gaps", *SUMS, "illegal", "cost")
    joined = sums.join(audits.withColumnRenamed("conv", "_conv"), F.expr("conv <=> _conv")).drop("_conv")

    asked = edits.selectExpr("conv", "part", "no", "start", "edits", "cast(null as string) as symbols", "cast(null as array<struct<role: string, text: string>>) as messages")
    given = held.selectExpr("conv", "part", "no", "cast(null as int) as start", "cast(null as string) as edits", "symbols", "messages")
    both = asked.unionByName(given).repartition(parts, "conv").sortWithinPartitions("conv", "part", "no", F.expr("messages is not null"))
    messages = task(both, written, "part int, no bigint, place int, edit string, role string, text string", kind)
    return joined.withColumnRenamed("conv", key), messages.withColumnRenamed("conv", key)


def digested(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    last, sha, started = None, None, False
    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not started or conv != last:
                if started:
                    out.append({"conv": last, "sha256": sha.hexdigest()})
                last, sha, started = conv, hashlib.sha256(), True
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if started:
        yield pa.RecordBatch.from_pylist([{"conv": last, "sha256": sha.hexdigest()}], schema)


def digests(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """SHA-256 of each conversation's repaired messages (``role:text``, joined by line breaks), as they stand in their task."""
    kind = messages.schema[key].dataType.simpleString()
    return task(messages.select(key, "role", "text"), digested, "sha256 string", kind).withColumnRenamed("conv", key)

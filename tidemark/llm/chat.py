"""Records of many layouts to canonical turns, and turns to one training text.

A record is a JSON object.  Its layout is told by a fingerprint, the hash of
its nested field paths; each known fingerprint selects a declarative mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

TURNS = "array<struct<role: string, text: string>>"

# Names of roles in layouts that have their own.
ROLES = {
    "human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant",
}
# Declarative mappings, in the order in which they are tried: the field paths a
# record must have (one of each group), then either the list with the names of
# its role and text fields and of the roles to rename, or (role, path) by turn.
MAPPINGS = {
    "messages": (
        (("messages[].role",), ("messages[].content", "messages[].content[]", "messages[].content[].text")),
        ("$.messages", "role", "content", {}),
    ),
    "conversations": (
        (("conversations[].from",), ("conversations[].value", "conversations[].value[]", "conversations[].value[].text")),
        ("$.conversations", "from", "value", ROLES),
    ),
    "completion": ((("prompt",), ("completion",)), (("user", "$.prompt"), ("assistant", "$.completion"))),
    "instruction": (
        (("instruction",), ("input",), ("output",)),
        (("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")),
    ),
    "instruction_only": ((("instruction",), ("output",)), (("user", "$.instruction"), ("assistant", "$.output"))),
    "question": ((("question",), ("answer",)), (("user", "$.question"), ("assistant", "$.answer"))),
}
# A layout that turns into another when a field of it is empty.
WITHOUT = {"instruction": ("$.input", "instruction_only")}


def fingerprint(record: str) -> str:
    """SQL for the sorted hashes of a variant's nested field paths, whatever the values' types.

    ``[]`` marks the items of a list.  Only paths of scalars, of values of mixed
    types and of empty lists' items count; an absent field differs from a null one.
    """
    token = r"`(?:[^`]|``)*`: |[^<>:,` ]+: |OBJECT<|ARRAY<|>|[A-Z]+(?:\\([0-9,]+\\))?"
    step = (
        "case when endswith(t, ': ') then named_struct('at', a.at, 'key', rtrim(': ', trim('`', rtrim(': ', t))), 'out', a.out) "
        "when t = 'OBJECT<' then named_struct('at', array_append(a.at, concat(element_at(a.at, -1), a.key, '.')), 'key', '', 'out', a.out) "
        "when t = 'ARRAY<' then named_struct('at', array_append(a.at, concat(element_at(a.at, -1), a.key, '[]')), 'key', '', 'out', a.out) "
        "when t = '>' then named_struct('at', slice(a.at, 1, size(a.at) - 1), 'key', '', 'out', a.out) "
        "else named_struct('at', a.at, 'key', '', 'out', array_append(a.out, concat(element_at(a.at, -1), a.key))) end"
    )
    tokens = f"regexp_extract_all(schema_of_variant({record}), '{token}', 0)"
    zero = "named_struct('at', array(''), 'key', '', 'out', cast(array() as array<string>))"
    return f"array_sort(array_distinct(transform(aggregate({tokens}, {zero}, (a, t) -> {step}).out, p -> xxhash64(if(startswith(p, '.'), substr(p, 2), p)))))"


def fits(needs: tuple) -> str:
    """SQL: whether ``_print`` has a path of each group; other fields do not matter."""
    return " and ".join(f"arrays_overlap(_print, array({', '.join(f"xxhash64('{p}')" for p in group)}))" for group in needs)


def text_of(value: str) -> str:
    """SQL for the text of a variant: itself, or the texts of the parts of a list; a part without a text gives none."""
    part = (
        "if(startswith(schema_of_variant(p), 'OBJECT'), try_variant_get(p, '$.text', 'string'), try_variant_get(p, '$', 'string'))"
    )
    parts = f"transform(try_variant_get({value}, '$', 'array<variant>'), p -> coalesce({part}, ''))"
    return (
        f"coalesce(if(startswith(schema_of_variant({value}), 'ARRAY'), array_join({parts}, ''), "
        f"try_variant_get({value}, '$', 'string')), '')"
    )


def turns_by(mapping: tuple) -> str:
    """SQL for the turns of a record ``_record`` under one mapping."""
    if isinstance(mapping[0], str):
        path, role, text, renamed = mapping
        got = f"try_variant_get(_record, '{path}', 'array<variant>')"
        found = f"coalesce(try_variant_get(x, '$.{role}', 'string'), '')"
        for old, new in renamed.items():
            found = f"if(lower(try_variant_get(x, '$.{role}', 'string')) = '{old}', '{new}', {found})"
        content = f"try_variant_get(x, '$.{text}', 'variant')"
        return f"transform({got}, x -> named_struct('role', {found}, 'text', {text_of(content)}))"
    one = (f"named_struct('role', '{r}', 'text', {text_of(f"try_variant_get(_record, '{p}', 'variant')")})" for r, p in mapping)
    return f"array({', '.join(one)})"


def canonical(df: DataFrame, record: str, mappings: dict[str, tuple] | None = None) -> DataFrame:
    """Add ``layout`` and ``turns`` (array of role and text) to records in JSON.

    A mapping is selected by the hashes of the paths it needs; further fields
    are ignored.  Roles are renamed as the mapping says.  A text given as a list
    of parts is their texts in order.  An instruction with an empty ``input`` is
    the user's.  A record that is null, no JSON or of no known layout keeps its
    row, with null in both.  Null roles and texts become empty.  An empty list
    of turns gives no turns.  Columns named like the two are replaced, others kept.
    """
    mappings = MAPPINGS if mappings is None else mappings
    kept = [c for c in df.columns if c not in ("layout", "turns")]
    columns = "".join(f", '{c}', `{c}`" for c in kept)
    read = df.selectExpr(f"named_struct('_', 0{columns}) as _in", f"try_parse_json(`{record}`) as _record")
    read = read.selectExpr("*", f"{fingerprint('_record')} as _print")
    layout = "".join(f" when {fits(needs)} then '{name}'" for name, (needs, _) in mappings.items())
    turns = "".join(f" when _layout = '{name}' then {turns_by(mapping)}" for name, (_, mapping) in mappings.items())
    lists = [m[0][2:] for _, m in mappings.values() if isinstance(m[0], str)]
    empty = fits((tuple(f"{name}[]" for name in lists),)) if lists else "false"
    instead = "".join(
        f" when _layout = '{a}' and {text_of(f"try_variant_get(_record, '{path}', 'variant')")} = '' then '{b}'"
        for a, (path, b) in WITHOUT.items() if a in mappings and b in mappings
    )
    read = read.selectExpr("*", f"case{layout} when {empty} then 'empty' end as _layout")
    read = read.selectExpr("_in", "_record", f"case{instead} else _layout end as _layout") if instead else read
    return read.selectExpr(
        *(f"_in.`{c}`" for c in kept), "_layout as layout",
        f"cast(case when _layout = 'empty' then array(){turns} end as {TURNS}) as turns",
    )


def escaped(text: str) -> str:
    r"""SQL: ``\`` becomes ``\b`` and the ``<`` of a turn mark ``\l``; nothing else changes."""
    return rf"regexp_replace(replace({text}, r'\', r'\b'), r'<(?=/?turn)', r'\\l')"


def unescaped(text: str) -> str:
    r"""SQL for the way back: each ``\`` is followed by exactly one code letter."""
    return rf"replace(replace(replace({text}, r'\l', '<'), r'\g', '>'), r'\b', r'\')"


def formatted(df: DataFrame, learnt: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` to rows with canonical ``turns``.

    A turn is ``<turn ROLE>\\n``, its text and ``</turn>\\n``; control strings
    in roles and texts are escaped reversibly.  A span is start and end, in
    code points, of an escaped text to learn from.  No turns give empty text,
    null turns give null.  Columns named like the two are replaced.
    """
    head = f"concat('<turn ', replace({escaped('x.role')}, '>', r'\\g'), '>\\n')"
    parts = f"transform(turns, x -> named_struct('role', x.role, 'head', {head}, 'body', {escaped('x.text')}))"
    step = (
        "named_struct('at', a.at + length(p.head) + length(p.body) + 8, "
        f"'spans', if(p.role = '{learnt}', array_append(a.spans, named_struct('start', a.at + length(p.head), "
        "'end', a.at + length(p.head) + length(p.body))), a.spans))"
    )
    zero = "named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, end: int>>))"
    return (
        df.drop("formatted", "loss_spans")
        .selectExpr("*", f"{parts} as _parts")
        .selectExpr(
            "*",
            "array_join(transform(_parts, p -> concat(p.head, p.body, '</turn>\\n')), '') as formatted",
            f"aggregate(_parts, {zero}, (a, p) -> {step}).spans as loss_spans",
        )
        .drop("_parts")
    )


def parsed(df: DataFrame) -> DataFrame:
    """Add ``read_turns`` and ``loss_text``, both read from ``formatted`` and ``loss_spans`` alone."""
    turn = (
        "named_struct('role', " + unescaped("substr(p, 7, locate('>\\n', p) - 7)")
        + ", 'text', " + unescaped("substr(p, locate('>\\n', p) + 2)") + ")"
    )
    pieces = "slice(split(formatted, '</turn>\\n'), 1, size(split(formatted, '</turn>\\n')) - 1)"
    masked = unescaped("substr(formatted, s.start + 1, s.end - s.start)")
    return df.drop("read_turns", "loss_text").selectExpr(
        "*",
        f"transform({pieces}, p -> {turn}) as read_turns",
        f"array_join(transform(loss_spans, s -> {masked}), '') as loss_text",
    )

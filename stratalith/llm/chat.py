"""Chat formatting by schema fingerprints. DataFrame functions only; no Python on the executors.

A record (a JSON text as a variant, or the rows of a table) has nested field paths: `$.messages`, `$.messages[].role`, ... Their hash is its
fingerprint. The fingerprints of the declared layouts select the mapping at once; a record with more fields than a layout declares takes the
first layout, in order of declaration, whose required paths it has. Names count, values don't: a null in a field is a field. A layout counts
only if the values under its paths are texts: strings and other single values, lists of strings or of `{"type": "text", "text": ...}` parts (joined with
nothing between), or one such part. The mapping turns the record into canonical turns (role, text); of a preference pair, the chosen answer. A table of turns has one schema, so its fingerprint is taken once, from
the schema. Turns are then written in a template that marks every turn and escapes control strings inside roles and texts reversibly, with
the spans of a loss mask over the texts of the assistant.

Defined results: a null text is empty; a null or unknown role is kept as it is (null: empty); records that no layout fits (empty lists of
messages, parts that are no text, messages that call tools among them) keep layout null and have no turns, `layout_counts` tells how many; turns with equal order are sorted by role, then text; null turns come last; repeated rows are
turns of their own. Columns of a table other than its conversation, turn, role and text are left aside, whatever their names; columns of records
named layout, fingerprint or like the turns are replaced. A conversation is one output string, so its size is bounded by what a row can hold; its
turns meet in one group for that reason alone.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain, combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# fixed values: control strings of the template
START, END = "<|im_start|>", "<|im_end|>"

#: name -> required paths, optional paths, mapping. A mapping is a list of (role, path), or an array path with its role and text fields,
#: with turns before it; several array paths follow each other. The first layout that fits counts.
LAYOUTS: dict[str, dict] = {
    "messages": {"required": ["$.messages[].role", "$.messages[].content"], "optional": ["$.system", "$.messages[].content[].type", "$.messages[].content[].text"], "before": [("system", "$.system")], "each": (["$.messages"], "role", "content")},
    "conversations": {"required": ["$.conversations[].from", "$.conversations[].value"], "optional": ["$.system"], "before": [("system", "$.system")], "each": (["$.conversations"], "from", "value")},
    "instruction": {"required": ["$.instruction", "$.output"], "optional": ["$.input", "$.system"], "turns": [("system", "$.system"), ("user", "$.instruction", "$.input"), ("assistant", "$.output")]},
    "instruction_response": {"required": ["$.instruction", "$.response"], "optional": ["$.input", "$.system"], "turns": [("system", "$.system"), ("user", "$.instruction", "$.input"), ("assistant", "$.response")]},
    "prompt_completion": {"required": ["$.prompt", "$.completion"], "optional": ["$.system"], "turns": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.completion")]},
    "prompt_response": {"required": ["$.prompt", "$.response"], "optional": ["$.system"], "turns": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")]},
    "prompt_completion_messages": {"required": ["$.prompt[].role", "$.prompt[].content", "$.completion[].role", "$.completion[].content"], "optional": [], "before": [], "each": (["$.prompt", "$.completion"], "role", "content")},
    "preference": {"required": ["$.prompt", "$.chosen", "$.rejected"], "optional": ["$.system"], "turns": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.chosen")]},
    "preference_messages": {"required": ["$.chosen[].role", "$.chosen[].content", "$.rejected[].role", "$.rejected[].content"], "optional": ["$.prompt"], "before": [], "each": (["$.chosen"], "role", "content")},
    "preference_answers": {"required": ["$.prompt[].role", "$.prompt[].content", "$.chosen[].role", "$.chosen[].content"], "optional": ["$.rejected[].role", "$.rejected[].content"], "before": [], "each": (["$.prompt", "$.chosen"], "role", "content")},
    "question_answer": {"required": ["$.question", "$.answer"], "optional": ["$.context"], "turns": [("system", "$.context"), ("user", "$.question"), ("assistant", "$.answer")]},
    "turn": {"required": ["$.role", "$.text"], "optional": ["$.turn"], "one": ("$.role", "$.text")},
    "turn_content": {"required": ["$.role", "$.content"], "optional": ["$.turn"], "one": ("$.role", "$.content")},
    "turn_value": {"required": ["$.from", "$.value"], "optional": ["$.turn"], "one": ("$.from", "$.value")},
}
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Types of parts that are texts, and fields of a message that are no text.
TEXT_PARTS = ["text", "input_text", "output_text"]
CALLS = ["tool_calls", "function_call"]

_TURNS = "array<struct<role:string,text:string>>"


def path_hash(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def with_parents(paths: list[str]) -> set[str]:
    """`paths` and the arrays and objects they lie in."""
    return {p for path in paths for p in (path, path.split("[]")[0])}


def layout_hashes() -> dict[str, str]:
    """Fingerprint -> layout, for every choice of a layout's optional paths."""
    out: dict[str, str] = {}
    for name, x in LAYOUTS.items():
        for extra in chain.from_iterable(combinations(x["optional"], n) for n in range(len(x["optional"]) + 1)):
            out.setdefault(path_hash(list(with_parents([*x["required"], *extra]))), name)
    return out


def schema_paths(kind: DataType, at: str = "$") -> list[str]:
    """Nested field paths of a schema."""
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in (f"{at}.{f.name}", *schema_paths(f.dataType, f"{at}.{f.name}"))]
    return []


def schema_layout(schema: StructType, rows_of_turns: bool = False) -> str | None:
    """The layout of a table's rows by its schema: any, or only one of a turn a row."""
    paths = set(schema_paths(schema))
    nested = {f"$.{f.name}" for f in schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    some = {name: x for name, x in LAYOUTS.items() if not nested & set(x.get("one", ())) and ("one" in x or not rows_of_turns)}
    exact = layout_hashes().get(path_hash(list(paths)))
    return exact if exact in some else next((name for name, x in some.items() if paths >= set(x["required"])), None)


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a variant: its schema, read as names, openings and closings, over a stack of the places they stand at."""
    parts = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"`(?:[^`]|``)*`: |\w+: |\w+<|>"), F.lit(0))
    state = F.struct(F.array(F.lit("$")).alias("stack"), F.lit("$").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, part: Column) -> Column:
        top = F.element_at(a["stack"], -1)
        path = F.concat(top, F.lit("."), F.regexp_replace(part, F.lit("^`|`?: $"), F.lit("")))
        inside = F.when(part == "ARRAY<", F.concat(a["at"], F.lit("[]"))).otherwise(a["at"])
        return (
            F.when(part == ">", F.struct(F.slice(a["stack"], 1, F.greatest(F.size(a["stack"]) - 1, F.lit(1))).alias("stack"), a["at"].alias("at"), a["out"].alias("out")))
            .when(F.endswith(part, F.lit("<")), F.struct(F.concat(a["stack"], F.array(inside)).alias("stack"), inside.alias("at"), a["out"].alias("out")))
            .otherwise(F.struct(a["stack"].alias("stack"), path.alias("at"), F.concat(a["out"], F.array(path)).alias("out")))
        )

    return F.array_sort(F.array_distinct(F.coalesce(F.aggregate(parts, state, step, lambda a: a["out"]), F.expr("cast(array() as array<string>)"))))


def _inside(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _role(v: Column) -> Column:
    """A role by its usual name; null if the value is a list or an object."""
    nested = F.coalesce(F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)<"), F.lit(False))
    return F.when(~nested, _named(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))))


def _named(role: Column) -> Column:
    names = F.create_map(*[F.lit(v) for kv in ROLES.items() for v in kv])
    return F.coalesce(F.try_element_at(names, F.coalesce(role, F.lit(""))), role)


def _text(v: Column) -> Column:
    """The text of a value (empty: null), null if it is no text."""

    def part(p: Column) -> Column:
        text = _inside(p, "$.text")
        a_part = F.schema_of_variant(p).startswith("OBJECT<") & (F.schema_of_variant(text) == "STRING") & F.coalesce(F.try_variant_get(p, "$.type", "string"), F.lit("text")).isin(TEXT_PARTS)
        return F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).when(a_part, F.try_variant_get(text, "$", "string"))

    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), part)
    listed = F.when(F.forall(parts, lambda p: p.isNotNull()), F.array_join(parts, ""))
    return F.when(kind == "VOID", F.lit("")).when(kind.startswith("ARRAY<"), listed).when(kind.startswith("OBJECT<"), part(v)).otherwise(F.try_variant_get(v, "$", "string"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _message(m: Column, role: str, text: str) -> Column:
    """A turn of a message; its text is null if it is no text, or if the message calls something."""
    calls = [F.coalesce(F.schema_of_variant(_inside(m, f"$.{c}")), F.lit("VOID")).isin("VOID", "ARRAY<VOID>") for c in CALLS]
    return _turn(_role(_inside(m, f"$.{role}")), F.when(reduce(and_, calls), _text(_inside(m, f"$.{text}"))))


def _mapping(record: Column, x: dict) -> Column:
    """Turns of a record by the layout `x`; null if a value under its paths is no text."""
    get = lambda p: _inside(record, p)
    said = lambda p: F.coalesce(F.schema_of_variant(get(p)), F.lit("VOID")) != "VOID"
    there = lambda turns: F.filter(F.array(*turns), lambda t: t.isNotNull())
    if "one" in x:
        turns = F.array(_turn(_role(get(x["one"][0])), _text(get(x["one"][1]))))
    elif "turns" in x:
        # optional turns are there if they say something; a text of several fields joins those that aren't empty
        several = lambda paths: F.when(reduce(and_, [_text(get(p)).isNotNull() for p in paths]), F.concat_ws("\n", *[F.when(_text(get(p)) != "", _text(get(p))) for p in paths]))
        turns = there([F.when(F.lit(t[1] in x["required"]) | said(t[1]), _turn(F.lit(t[0]), several(t[1:]) if len(t) > 2 else _text(get(t[1])))) for t in x["turns"]])
    else:
        paths, role, text = x["each"]
        turns = F.concat(*[F.transform(F.try_variant_get(record, p, "array<variant>"), lambda m: _message(m, role, text)) for p in paths])
        if x["before"]:
            turns = F.concat(there([F.when(said(p), _turn(F.lit(r), _text(get(p)))) for r, p in x["before"]]), turns)
    return F.when(F.forall(turns, lambda t: t["role"].isNotNull() & t["text"].isNotNull()), turns)


def canonical_turns(records: DataFrame, record: Column, name: str = "turns") -> DataFrame:
    """`records` with `fingerprint`, `layout` (null: none fits) and the canonical turns of the variant `record`."""
    table = F.create_map(*[F.lit(v) for kv in layout_hashes().items() for v in kv])
    out = records.withColumn("_record", record).withColumn("_paths", field_paths(F.col("_record"))).withColumn("fingerprint", F.sha2(F.array_join("_paths", "\n"), 256))
    exact = F.try_element_at(table, F.col("fingerprint"))
    has = lambda x: F.size(F.array_except(F.array(*map(F.lit, x["required"])), F.col("_paths"))) == 0
    out = out.withColumn("_made", F.struct(*[F.when(has(x), _mapping(F.col("_record"), x).cast(_TURNS)).alias(layout) for layout, x in LAYOUTS.items()]))
    fits = {layout: F.col(f"_made.{layout}").isNotNull() for layout in LAYOUTS}
    out = out.withColumn("layout", F.coalesce(*[F.when((exact == layout) & fit, F.lit(layout)) for layout, fit in fits.items()], *[F.when(fit, F.lit(layout)) for layout, fit in fits.items()]))
    cases = [F.when(F.col("layout") == layout, F.col(f"_made.{layout}")) for layout in LAYOUTS]
    return out.withColumn(name, F.coalesce(*cases, F.expr(f"cast(array() as {_TURNS})"))).drop("_record", "_paths", "_made")


def layout_counts(found: DataFrame) -> DataFrame:
    """(fingerprint, layout, n) of canonical_turns' rows: layout null tells what no layout fitted."""
    return found.groupBy("fingerprint", "layout").agg(F.count("*").alias("n"))


def from_json_text(col: str) -> Column:
    """The variant of a JSON text; null if it isn't JSON."""
    return F.try_parse_json(F.col(col))


def escape(x: Column) -> Column:
    """No control string is left: `\\` becomes `\\e`, the beginning `<|` of a control string `<\\p`, a line feed in a role `\\n`."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("<\\p"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<\\p"), F.lit("<|")), F.lit("\\e"), F.lit("\\"))


def _fold(lengths: Column) -> Column:
    """Running sums of a short array, without the last."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(lengths, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def _starts(lengths: Column, block: int = 256) -> Column:
    """Running sums of an array, without the last: over blocks, then in them, as a fold copies what it has at every step."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / block) - 1, F.lit(0)).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    before = _fold(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)))
    return F.flatten(F.zip_with(blocks, before, lambda x, at: F.transform(_fold(x), lambda n: n + at)))


def format_turns(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """`conversations` with `formatted` and `loss_mask`, spans (start, end) in code points of the assistant's texts in it."""
    marked = F.transform(F.col(turns), lambda t: F.struct(F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    tail = len(END) + 1
    out = conversations.withColumn("_marked", marked).withColumn("formatted", F.array_join(F.transform("_marked", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), ""))
    out = out.withColumn("_lengths", F.transform("_marked", lambda t: (F.char_length(t["head"]) + F.char_length(t["body"]) + tail).cast("long"))).withColumn("_at", _starts(F.col("_lengths")))
    spans = F.zip_with("_marked", "_at", lambda t, at: F.when(t["learn"], F.struct((at + F.char_length(t["head"])).alias("start"), (at + F.char_length(t["head"]) + F.char_length(t["body"])).alias("end"))))
    return out.withColumn("loss_mask", F.filter(spans, lambda s: s.isNotNull())).drop("_marked", "_lengths", "_at")


def read_back(formatted: DataFrame) -> DataFrame:
    """`formatted` with `read`: turns parsed from the formatted string, `learn` telling which texts lie under the loss mask."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 1 - 2)
    out = formatted.withColumn("_parts", parts).withColumn("_lengths", F.transform("_parts", lambda p: (F.char_length(p) + len(START)).cast("long"))).withColumn("_at", _starts(F.col("_lengths")))
    head = lambda p: F.substring_index(p, "\n", 1)
    # turns and spans sorted together by where their text begins: a turn is learned if a span comes just before it
    place = lambda at, i: F.struct(at.cast("long").alias("at"), i.cast("int").alias("i"))
    texts = F.zip_with("_parts", "_at", lambda p, at: at + len(START) + F.char_length(head(p)) + 1)
    both = F.array_sort(F.concat(F.transform("loss_mask", lambda s: place(s["start"], F.lit(-1))), F.transform(texts, lambda at, i: place(at, i))))
    out = out.withColumn("_both", both)
    learned = F.filter(F.transform("_both", lambda x, n: F.when(x["i"] >= 0, (n > 0) & (F.get(F.col("_both"), n - 1)["i"] == -1) & (F.get(F.col("_both"), n - 1)["at"] == x["at"]))), lambda x: x.isNotNull())
    read = F.zip_with(
        "_parts",
        "_learn",
        lambda p, learn: F.struct(
            unescape(F.replace(head(p), F.lit("\\n"), F.lit("\n"))).alias("role"),
            unescape(F.substring(p, F.char_length(head(p)) + 2, F.char_length(p) - F.char_length(head(p)) - 1 - len(END) - 1)).alias("text"),
            F.coalesce(learn, F.lit(False)).alias("learn"),
        ),
    )
    return out.withColumn("_learn", learned).withColumn("read", read).drop("_parts", "_lengths", "_at", "_both", "_learn")


def conversations_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", layout: str | None = None) -> DataFrame:
    """One row per conversation: conv_col, turns in order of turn. The fingerprint of the table's schema selects the mapping (or `layout` names it).

    A row of one turn is a turn even if all its columns are null.
    """
    layout = layout or schema_layout(rows.schema, rows_of_turns=True)
    if layout is None or "one" not in LAYOUTS[layout]:
        raise ValueError(f"no layout of turns fits columns {rows.columns}")
    role, text = (F.coalesce(F.col(f"`{p[2:]}`").cast("string"), F.lit("")) for p in LAYOUTS[layout]["one"])
    turn = F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"), _named(role).alias("role"), text.alias("text"))
    grouped = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list(turn)).alias("_rows"))
    return grouped.select(conv_col, F.transform("_rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def digest(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what was read back."""
    loss = F.array_join(F.transform(F.filter("read", lambda t: t["learn"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )

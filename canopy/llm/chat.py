"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a JSON object.  Its field paths (top-level names, and names within the first element of
its lists) that any mapping knows are sorted and hashed; the hash selects a mapping, which names
where the turns' roles and texts are.  Turns are then written with a template that marks them,
with control strings inside texts escaped reversibly, and with the spans of the text to learn from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import let, sums_before


@dataclass(frozen=True)
class Mapping:
    """``list_of``: (list, role field, text field), turns in order; else ``fields``: (role, fields joined by a
    blank line), where empty texts give no turn."""

    name: str
    list_of: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    system: str | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        if self.list_of:
            top, role, text = self.list_of
            found = [top, f"{top}[].{role}", f"{top}[].{text}"]
        else:
            found = [f for _, names in self.fields for f in names]
        return tuple(sorted({*found, *([self.system] if self.system else [])}))


def _with_system(m: Mapping) -> tuple[Mapping, Mapping]:
    return m, Mapping(m.name + "_system", m.list_of, m.fields, "system")


MAPPINGS = tuple(x for m in (
    Mapping("messages", ("messages", "role", "content")),
    Mapping("chat", ("chat", "role", "content")),
    Mapping("conversations", ("conversations", "from", "value")),
    Mapping("turns", ("turns", "speaker", "text")),
    Mapping("prompt_completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction_response", fields=(("user", ("instruction",)), ("assistant", ("response",)))),
) for x in _with_system(m))

#: Role names of some layouts and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}

START, END = "<|im_start|>", "<|im_end|>\n"
_END = r"<\|im_end\|>\n"
#: Control strings of this and other templates, with any backslashes after the first character.
CONTROL = r"([<\[])(\\*)(\|[a-z_]{1,32}\|>|/?s>|</?SYS>>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|[a-z_]{1,32}\|>|/?s>|</?SYS>>|/?INST\])"


#: Spark's JSON functions give null for a string above this many characters; ``from_json`` alone can be told another limit.
JSON_STRING = 20_000_000
_ANY_LENGTH = {"maxStringLen": "2147483647"}


def field_paths(record: Column) -> Column:
    """Sorted known field paths of a JSON object; empty for what is none."""
    known = sorted({p for m in MAPPINGS for p in m.paths})
    lists = sorted({m.list_of[0] for m in MAPPINGS if m.list_of})
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    inner = [F.transform(F.coalesce(_names_in_first(record, n), F.array().cast("array<string>")), _prefixed(n)) for n in lists]
    return F.array_sort(F.array_intersect(F.concat(top, *inner), F.array(*[F.lit(p) for p in known])))


def _names_in_first(record: Column, name: str) -> Column:
    """Names within the first element of a list, also where its texts are above ``JSON_STRING``."""
    found = F.json_object_keys(F.get_json_object(record, f"$.{name}[0]"))
    long = F.from_json(record, f"struct<`{name}`: array<map<string,string>>>", _ANY_LENGTH)[name]
    return F.coalesce(found, F.when(F.length(record) > JSON_STRING, F.map_keys(F.get(long, F.lit(0)))))


def _prefixed(name: str):
    return lambda k: F.concat(F.lit(name + "[]."), k)


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with layout (a mapping's name, null if none fits), schema_fingerprint and turns
    (array<struct<role, text>>, empty if none fits).

    Null texts within records are empty texts; null roles are empty roles; a null or broken record has no
    turns.  Texts are read whole at any length that a string can have.  Repeated rows are as any; an empty table gives no rows; input columns of these three names
    are replaced."""
    lists = sorted({m.list_of for m in MAPPINGS if m.list_of})
    plain = sorted({f for m in MAPPINGS for _, names in m.fields for f in names} | {"system"})
    schema = ", ".join([*(f"{t}: array<struct<`{r}`: string, `{x}`: string>>" for t, r, x in lists), *(f"`{f}`: string" for f in plain)])
    out = records.withColumn("schema_fingerprint", fingerprint(field_paths(F.col(record_col))))
    layout = F.lit(None).cast("string")
    seen = F.array_join
    for m in MAPPINGS:
        layout = F.when(F.col("schema_fingerprint") == F.xxhash64(seen(F.array(*[F.lit(p) for p in m.paths]), "\n")),
                        m.name).otherwise(layout)
    out = out.withColumn("layout", layout).withColumn("turns", F.from_json(
        F.col(record_col), f"struct<{schema}>", _ANY_LENGTH))
    none = F.array().cast("array<struct<role:string,text:string>>")
    role = lambda c: let(F.coalesce(c, F.lit("")), lambda r: F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), r), r))
    turn = lambda r, t: F.struct(r.alias("role"), F.coalesce(t, F.lit("")).alias("text"))
    parsed, found = F.col("turns"), none
    for m in MAPPINGS:
        if m.list_of:
            top, r, x = m.list_of
            own = F.transform(parsed[top], _turn_of(turn, role, r, x))
        else:
            parts = [turn(F.lit(who), F.concat_ws("\n\n", *[F.nullif(parsed[f], F.lit("")) for f in names])) for who, names in m.fields]
            own = F.filter(F.array(*parts), lambda t: t["text"] != "")
        if m.system:
            first = turn(F.lit("system"), parsed[m.system])
            own = F.concat(F.filter(F.array(first), lambda t: t["text"] != ""), own)
        found = F.when(F.col("layout") == m.name, own).otherwise(found)
    return out.withColumn("turns", F.coalesce(found, none))


def _turn_of(turn, role, r: str, x: str):
    return lambda e: turn(role(e[r]), e[x])


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    """Backslashes are escaped before line feeds, so a pair is met before a line feed's."""
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(df: DataFrame, learn: str = "assistant") -> DataFrame:
    """``df`` (with turns) with formatted, and loss_spans: array<struct<start, end>>, code points of the
    escaped texts of ``learn`` turns in formatted.  No turns give an empty text and no spans."""
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    out = df.withColumn("formatted", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn"))))
    lengths = F.transform("formatted", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long"))
    out = out.withColumn("loss_spans", let(sums_before(lengths), lambda at: F.transform(F.filter(F.transform(
        F.col("formatted"), lambda p, i: F.struct((F.get(at, i) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("n"),
                                                  p["learn"].alias("learn"))), lambda s: s["learn"]),
        lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end")))))
    return out.withColumn("formatted", F.array_join(F.transform("formatted", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as they were: array<struct<role, text, start, end>>, start and end being
    those of the escaped text."""
    def turns(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: (F.length(p) + len(END)).cast("long"))
        return let(sums_before(lengths), lambda at: F.transform(pieces, lambda p, i: let(
            F.instr(p, "\n"), lambda cut: F.struct(
                _unescape_role(F.substring(p, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"),
                unescape(F.substring(p, cut + 1, F.lit(2147483647))).alias("text"),
                (F.get(at, i) + cut).alias("start"), (F.get(at, i) + F.length(p)).alias("end")))))

    return let(F.split(formatted, _END, -1), lambda ps: let(F.slice(ps, 1, F.size(ps) - 1), turns))


def masked(turns: str, spans: str) -> Column:
    """The turns (of ``read_back``) whose texts the loss spans name, in order.

    Spans and turns are sorted together, so that a span stands just before its turn; the cost follows the sort."""
    mark = lambda x, tag, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(tag).alias("tag"), i.alias("i"))
    both = F.array_sort(F.concat(F.transform(spans, lambda x: mark(x, 0, F.lit(-1))),
                                 F.transform(turns, lambda x, i: mark(x, 1, i))))
    of = let(both, lambda c: F.filter(F.transform(c, lambda x, j: F.when(
        (x["tag"] == 1) & (F.get(c, j - 1)["tag"] == 0) & (F.get(c, j - 1)["start"] == x["start"])
        & (F.get(c, j - 1)["end"] == x["end"]), x["i"]).otherwise(-1)), lambda i: i >= 0))
    return F.transform(of, lambda i: F.get(turns, i))


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows by turn (conv_id, turn, role, text): one JSON record a conversation.

    Turns are ordered by turn, role, text; null texts and roles are empty.  Conversations are written in the layouts that
    can hold them, dealt by a hash of their id: lists of turns hold any, pairs of fields a user and an assistant turn
    with texts, and the layouts with a system field a system turn with text before either.  An instruction with
    an input holds what its two parts, joined by a blank line, give back.  A conversation is one record, and so in one
    task: its hash is of its whole text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    head = F.get("t", F.lit(0))
    system = (F.size("t") > 1) & (head["role"] == "system") & (head["content"] != "")
    convs = convs.select("conv_id", F.when(system, head["content"]).alias("system"), F.when(system, F.slice("t", 2, F.size("t"))).otherwise(
        F.col("t")).alias("rest"))
    first, second = F.get("rest", F.lit(0)), F.get("rest", F.lit(1))
    pair = (F.size("rest") == 2) & (first["role"] == "user") & (second["role"] == "assistant") & (
        first["content"] != "") & (second["content"] != "")
    # No role may stand in a list that another name stands for there.
    plain = ~F.exists("rest", lambda x: x["role"].isin(list(ROLES)))
    split = F.instr(first["content"], "\n\n")
    convs = convs.withColumns({"pair": pair, "cut": F.when(pair & (split > 1) & (F.length(first["content"]) > split + 1), split)})
    may = [F.when(_may_hold(m, plain), F.lit(m.name)) for m in MAPPINGS]
    convs = convs.withColumn("layouts", F.filter(F.array(*may), lambda x: x.isNotNull()))
    convs = convs.withColumn("layout", F.when(F.size("layouts") > 0, F.get("layouts", F.pmod(
        F.xxhash64("conv_id"), F.size("layouts")).cast("int"))).when(
        F.col("system").isNull(), "messages").otherwise("messages_system"))
    record = F.lit(None).cast("string")
    for m in MAPPINGS:
        record = F.when(F.col("layout") == m.name, _written(m)).otherwise(record)
    return convs.select("conv_id", record.alias("record"))


def _may_hold(m: Mapping, plain: Column) -> Column:
    held = F.col("system").isNotNull() if m.system else F.col("system").isNull()
    if m.list_of:
        return held & (F.size("rest") > 0) & plain
    return held & F.col("pair") & (F.col("cut").isNotNull() if m.name.startswith("instruction_input") else F.lit(True))


def _written(m: Mapping) -> Column:
    """The conversation's record in a mapping's layout.  Assistants of the layouts that name them so are 'gpt' and
    'bot', users 'human'."""
    system = [F.col("system")] if m.system else []
    if m.list_of:
        top, role, text = m.list_of
        names = {"from": {"user": "human", "assistant": "gpt"}, "speaker": {"user": "human", "assistant": "bot"}}.get(role, {})

        def named(r: Column) -> Column:
            out = r
            for own, other in names.items():
                out = F.when(r == own, other).otherwise(out)
            return out

        turns = F.transform("rest", lambda x: F.struct(named(x["role"]).alias(role), x["content"].alias(text)))
        return F.to_json(F.struct(*system, turns.alias(top)))
    fields = []
    for (who, parts), turn in zip(m.fields, (F.get("rest", F.lit(0)), F.get("rest", F.lit(1)))):
        if len(parts) == 1:
            fields.append(turn["content"].alias(parts[0]))
        else:  # the text before the first blank line, and after it
            fields += [F.substring(turn["content"], F.lit(1), F.col("cut") - 1).alias(parts[0]),
                       F.substring(turn["content"], F.col("cut") + 2, F.lit(2147483647)).alias(parts[1])]
    return F.to_json(F.struct(*system, *fields))

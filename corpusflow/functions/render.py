"""Template rendering as column expressions: a template's slots become literals in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.templates import BOS, Marker, Template, Token
from corpusflow.functions.tokenizers import Tokenizer
from corpusflow.schema import ASSISTANT, FUNCTION, OBSERVATION, USER

# Wording of the tool prompt.
TOOL_PROMPT_HEAD = "You have access to the following tools:\n"
TOOL_PROMPT_USE = "Use the following format if using a tool:\n```\nAction: tool name (one of ["
TOOL_PROMPT_INPUT = "]).\nAction Input: the input to the tool"
TOOL_PROMPT_JSON = (
    ', in a JSON format representing the kwargs (e.g. ```{"input": "hello world", "num_beams": 5}```)'
)
TOOL_PROMPT_TAIL = ".\n```\n"

TOOLS_SCHEMA = (
    "array<struct<name:string,description:string,parameters:struct<"
    "properties:map<string,struct<type:string,description:string,enum:array<string>,items:struct<type:string>>>,"
    "required:array<string>>>>"
)


def fill_slot(slot: str, values: dict[str, Column], every: bool = False) -> Column:
    """TPL-04: the slot with each ``{{name}}`` filled in once (or wherever it stands), as one concat.

    The template is split at the placeholders, so text that itself contains ``{{idx}}`` stays as it is.
    """
    parts: list = [slot]
    for name, value in values.items():
        mark, filled, done = "{{" + name + "}}", [], False
        for part in parts:
            if not isinstance(part, str) or mark not in part or (done and not every):
                filled.append(part)
                continue
            pieces = part.split(mark) if every else part.split(mark, 1)
            for i, piece in enumerate(pieces):
                if i:
                    filled.append(value)
                filled.append(piece)
            done = True
        parts = filled
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts if not (isinstance(p, str) and p == "")]
    if not columns:
        return F.lit("")
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def spaced_json(compact: Column) -> Column:
    """Compact JSON with a blank after each ``:`` and ``,`` outside strings."""
    lexemes = F.regexp_extract_all(compact, F.lit(r'"(?:[^"\\]|\\.)*"|[,:]|[^",:]+'), F.lit(0))
    return F.array_join(F.transform(lexemes, lambda x: F.when(x.isin(",", ":"), F.concat(x, F.lit(" "))).otherwise(x)), "")


def function_parts(content: Column) -> tuple[Column, Column]:
    """Name and arguments of a JSON call; both empty when either is missing or the text is not JSON."""
    name = F.get_json_object(content, "$.name")
    raw = F.get_json_object(content, "$.arguments")  # keeps the order of keys; a text comes back without quotes and escapes
    parsed = F.try_parse_json(content)
    is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.arguments", "variant")) == "STRING"
    quoted = F.regexp_replace(F.to_json(F.array(raw)), r"^\[|\]$", "")
    arguments = F.when(is_text, quoted).otherwise(spaced_json(raw))
    valid = parsed.isNotNull() & name.isNotNull() & raw.isNotNull()
    return F.when(valid, name).otherwise(F.lit("")), F.when(valid, arguments).otherwise(F.lit(""))


def render_function_call(content: Column, slot: str = "Action: {{name}}\nAction Input: {{arguments}}") -> Column:
    """TPL-06."""
    name, arguments = function_parts(content)
    return fill_slot(slot, {"name": name, "arguments": arguments}, every=True)


def render_tools(tools: Column) -> Column:
    """TPL-07: prompt text for a JSON list of tools; '' when it is empty, invalid or incomplete.

    Numbers and other values in an ``enum`` are shown as they stand in the JSON.
    """
    parsed = F.from_json(tools, TOOLS_SCHEMA)

    def one_param(entry: Column, required: Column) -> Column:
        p = entry["value"]
        return F.concat(
            F.lit("  - "),
            entry["key"],
            F.lit(" ("),
            F.coalesce(p["type"], F.lit("")),
            F.when(F.coalesce(F.array_contains(required, entry["key"]), F.lit(False)), F.lit(", required")).otherwise(
                F.lit("")
            ),
            F.lit("): "),
            F.coalesce(p["description"], F.lit("")),
            F.when(
                F.coalesce(F.size(p["enum"]), F.lit(0)) > 0,
                F.concat(F.lit(", should be one of ["), F.array_join(p["enum"], ", "), F.lit("]")),
            ).otherwise(F.lit("")),
            F.when(
                p["items"]["type"].isNotNull(), F.concat(F.lit(", where each item should be "), p["items"]["type"])
            ).otherwise(F.lit("")),
            F.lit("\n"),
        )

    def one_tool(tool: Column) -> Column:
        entries = F.map_entries(tool["parameters"]["properties"])
        args = F.array_join(F.transform(entries, lambda e: one_param(e, tool["parameters"]["required"])), "")
        return F.concat(
            F.lit("> Tool Name: "),
            tool["name"],
            F.lit("\nTool Description: "),
            F.coalesce(tool["description"], F.lit("")),
            F.lit("\nTool Args:\n"),
            args,
            F.lit("\n"),
        )

    texts = F.transform(parsed, one_tool)
    prompt = F.concat(
        F.lit(TOOL_PROMPT_HEAD),
        F.array_join(texts, ""),
        F.lit(TOOL_PROMPT_USE),
        F.array_join(F.transform(parsed, lambda t: t["name"]), ", "),
        F.lit(TOOL_PROMPT_INPUT + TOOL_PROMPT_JSON + TOOL_PROMPT_TAIL),
    )
    # A tool without a name or parameters makes its text, and so one element of the list, NULL.
    complete = F.forall(texts, lambda t: t.isNotNull()) & (F.size(parsed) > 0)
    return F.when(complete, prompt).otherwise(F.lit(""))


def extract_action(text: Column) -> Column:
    """TPL-08: struct(is_tool, name, arguments) of a rendered call; otherwise arguments holds the whole text."""
    pattern = r"(?s)Action:\s*([a-zA-Z0-9_]+).*?Action Input:\s*(.*)"
    name = F.regexp_extract(text, pattern, 1)
    raw = F.regexp_replace(F.regexp_extract(text, pattern, 2), r"(?s)^\s+|\s+$", "")
    raw = F.regexp_replace(F.regexp_replace(raw, r'^"+|"+$', ""), r"^`+|`+$", "")
    parsed = F.try_parse_json(raw)
    ok = (name != "") & parsed.isNotNull()
    compact = F.when(
        F.regexp_like(raw, F.lit(r"^\s*[\[{]")), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    ).otherwise(raw)
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("is_tool"),
        F.when(ok, name).alias("name"),
        F.when(ok, spaced_json(compact)).otherwise(text).alias("arguments"),
    )


class Renderer:
    """Turns messages into pieces of one template; pieces become text (``text``) or tokens (``tokens``)."""

    def __init__(self, template: Template, bos: str | None = None, eos: str | None = None):
        self.template, self.bos, self.eos = template, bos, eos

    # A piece is (is_single_token, column).
    def _pieces(self, slots: tuple, values: dict[str, Column], every: bool = False) -> list[tuple[bool, Column]]:
        pieces = []
        for slot in slots:
            if isinstance(slot, Token):
                pieces.append((True, F.lit(slot.text)))
            elif isinstance(slot, Marker):
                mark = self.bos if slot == BOS else self.eos
                if mark is not None:
                    pieces.append((True, F.lit(mark)))
            else:
                pieces.append((False, fill_slot(slot, values, every)))
        return pieces

    def _message(
        self, msg: Column, i: Column, system: Column, tools: Column | None, join: Callable[[list], Column]
    ) -> Column:
        t = self.template
        system = F.coalesce(F.nullif(system, F.lit("")), F.lit(t.default_system))
        if t.force_system or t.default_system:
            shown = F.lit(True)
        else:
            shown = system != "" if tools is None else (system != "") | (F.coalesce(tools, F.lit("")) != "")
        system_text = system
        if tools is not None:
            with_tools = F.coalesce(tools, F.lit("")) != ""
            system_text = F.concat(system, F.when(with_tools, render_tools(tools)).otherwise(F.lit("")))
        content, idx = msg["content"], F.floor(i / 2).cast("string")
        first, later = (i == 0) & shown, (i > 0) & (i % 2 == 0)

        if t.inline_system:
            inside = fill_slot(t.system[0], {"content": system_text})
            user_content = F.concat(F.when(first, inside).otherwise(F.lit("")), content)
            prefix = join([])
        else:
            user_content = content
            prefix = F.when(first, join(self._pieces(t.system, {"content": system_text}))).otherwise(join([]))
        separator = F.when(later, join(self._pieces(t.separator, {}))).otherwise(join([]))
        name, arguments = function_parts(content)
        role = msg["role"]
        user_values = {"content": user_content} if t.inline_system else {"content": user_content, "idx": idx}
        body = (
            F.when(role == USER, join(self._pieces(t.user, user_values)))
            .when(role == ASSISTANT, join(self._pieces(t.slots("assistant"), {"content": content})))
            .when(role == OBSERVATION, join(self._pieces(t.slots("observation"), {"content": content})))
            .when(
                role == FUNCTION, join(self._pieces(t.slots("function"), {"name": name, "arguments": arguments}, True))
            )
            .otherwise(
                F.raise_error(F.concat(F.lit("unexpected role: "), F.coalesce(role, F.lit("NULL")))).cast(
                    "string" if self._as_text else "array<string>"
                )
            )
        )
        return F.concat(prefix, *([separator] if t.separator else []), body)

    def _join_text(self, pieces: list) -> Column:
        if len(pieces) == 1:
            return pieces[0][1]
        return F.concat(*[c for _, c in pieces]) if pieces else F.lit("")

    def text(self, messages: Column, system: Column, tools: Column | None) -> Column:
        """TPL-01/02: one rendered string per message; ``tools=None`` says that no row has tools."""
        self._as_text = True
        return F.transform(messages, lambda m, i: self._message(m, i, system, tools, self._join_text))

    def row_text(self, role: Column, content: Column, idx: Column, system: Column, tools: Column | None) -> Column:
        """The same for a table with one row per message, where no conversation is held in one row."""
        self._as_text = True
        return self._message(_row_message(role, content), idx, system, tools, self._join_text)

    def _join_tokens(self, tokenizer: Tokenizer) -> Callable[[list], Column]:
        def join(pieces: list) -> Column:
            arrays = [F.array(c) if whole else tokenizer(c) for whole, c in pieces]
            if len(arrays) == 1:
                return arrays[0]
            return F.concat(*arrays) if arrays else F.array().cast("array<string>")

        return join

    def tokens(self, messages: Column, system: Column, tools: Column | None, tokenizer: Tokenizer) -> Column:
        """TPL-10: one token array per message; literal text is tokenised, special tokens stay whole."""
        self._as_text = False
        join = self._join_tokens(tokenizer)
        return F.transform(messages, lambda m, i: self._message(m, i, system, tools, join))

    def row_tokens(
        self, role: Column, content: Column, idx: Column, system: Column, tools: Column | None, tokenizer: Tokenizer
    ) -> Column:
        """The same for a table with one row per message."""
        self._as_text = False
        return self._message(_row_message(role, content), idx, system, tools, self._join_tokens(tokenizer))


def _row_message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))

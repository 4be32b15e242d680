"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths. The hash of that set
selects a declarative mapping, which says where the canonical turns (role, text)
lie: in a list of messages, or in single fields with fixed roles. Fields outside
the mapping's paths would change the hash, so mappings also name the fields
they need and those they ignore; a record matches through the hash of its
relevant paths.

Formatted text is `<|im_start|>ROLE\\nTEXT<|im_end|>\\n` per turn. Control strings in
texts are escaped: between `<` and `|` stands one backslash more than before, so
no text holds `<|` and unescaping is exact. The loss mask covers assistant texts.

Null records, records of an unknown layout and records without turns have no
turns; null texts are empty, null roles are `user` in messages.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_map

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
# Names of roles in public layouts.
ROLE_NAMES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "assistant": "assistant",
              "system": "system", "tool": "tool", "function": "tool", "observation": "tool"}


@dataclass(frozen=True)
class Mapping:
    """Where the turns of one layout lie.

    `fields`: (path, role) of single texts, in turn order. `messages`: path of a
    list with `role` and `text` paths inside. `pairs`: path of a list of
    two-element lists, user then assistant. `joined`: paths appended to the
    first field's text after a blank line.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role: str = "role"
    text: str = "content"
    pairs: str = ""
    joined: tuple[str, ...] = ()

    def paths(self) -> frozenset[str]:
        own = {p for p, _ in self.fields} | set(self.joined)
        if self.messages:
            own |= {f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"}
        if self.pairs:
            own.add(f"{self.pairs}[][]")
        return frozenset(own)


#: Layouts known without further declaration; texts, roles and lists may also be missing where the layout says so.
LAYOUTS: tuple[Mapping, ...] = (
    Mapping("messages", messages="messages"),
    Mapping("messages with system", fields=(("system", "system"),), messages="messages"),
    Mapping("conversations", messages="conversations", role="from", text="value"),
    Mapping("conversations with system", fields=(("system", "system"),), messages="conversations", role="from", text="value"),
    Mapping("dialogue", messages="turns", role="role", text="text"),
    Mapping("speaker turns", messages="dialog", role="speaker", text="text"),
    Mapping("prompt and response", fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt and completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("system, prompt, response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("question and answer", fields=(("question", "user"), ("answer", "assistant"))),
    Mapping("system, question, response", fields=(("system_prompt", "system"), ("question", "user"), ("response", "assistant"))),
    Mapping("instruction", fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction with input", fields=(("instruction", "user"), ("output", "assistant")), joined=("input",)),
    Mapping("instruction with context", fields=(("instruction", "user"), ("response", "assistant")), joined=("context",)),
    Mapping("instruction and response", fields=(("instruction", "user"), ("response", "assistant"))),
    Mapping("nested data", fields=(("data.prompt", "user"), ("data.response", "assistant"))),
    Mapping("history", fields=(("prompt", "user"), ("response", "assistant")), pairs="history"),
    Mapping("single row turn", fields=(("text", "*role"), ("role", "*"))),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a record; list elements share the path `[]`."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {prefix}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@lru_cache(maxsize=16)
def _index(layouts: tuple[Mapping, ...]):
    by_hash = {}
    for mapping in layouts:
        by_hash.setdefault(fingerprint(mapping.paths()), mapping)
    known = sorted({p for m in layouts for p in m.paths()})
    return by_hash, frozenset(known)


@lru_cache(maxsize=4096)
def _select(paths: frozenset[str], layouts: tuple[Mapping, ...]) -> Mapping | None:
    by_hash, known = _index(layouts)
    exact = by_hash.get(fingerprint(paths))
    if exact:
        return exact
    # Paths that no layout names (ids, scores, dates) don't take part; empty lists stand for their contents.
    relevant = set(paths & known)
    for p in paths - known:
        if p.endswith("[]"):
            relevant |= {k for k in known if k.startswith(p)}
    best = by_hash.get(fingerprint(relevant))
    if best:
        return best
    fitting = [m for m in layouts if m.paths() <= relevant]
    return max(fitting, key=lambda m: len(m.paths())) if fitting else None


def _at(value, path: str):
    for key in path.split("."):
        if not isinstance(value, dict):
            return None
        value = value.get(key)
    return value


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):  # parts of a message: their texts in order
        return "".join(_text(v.get("text") if isinstance(v, dict) else v) for v in value)
    return json.dumps(value, ensure_ascii=False)


def _role(value) -> str:
    name = _text(value)
    return ROLE_NAMES.get(name.strip().lower(), name) if name else "user"


def canonical_turns(record, layouts: tuple[Mapping, ...] = LAYOUTS) -> tuple[str | None, str, list[tuple[str, str]]]:
    """(name of the mapping, schema fingerprint, turns) of one parsed record."""
    paths = frozenset(field_paths(record)) if isinstance(record, (dict, list)) and record else frozenset()
    own = fingerprint(paths)
    if isinstance(record, list):
        record, paths = {"messages": record}, frozenset("messages" + p for p in paths)
    mapping = _select(paths, layouts) if paths else None
    if mapping is None and isinstance(record, dict):  # null roles or texts drop whole paths in other writers' files
        listed = [m for m in layouts if m.messages and isinstance(_at(record, m.messages), list) and any(isinstance(x, dict) and (m.text in x) for x in _at(record, m.messages))]
        mapping = listed[0] if listed else None
    if mapping is None:
        return None, own, []
    turns: list[tuple[str, str]] = []
    if mapping.pairs:
        for pair in _at(record, mapping.pairs) or []:
            if isinstance(pair, list):
                turns += [(role, _text(text)) for role, text in zip(("user", "assistant"), pair)]
    for k, (path, role) in enumerate(mapping.fields):
        if role == "*":
            continue
        value = _at(record, path)
        if role == "system" and value in (None, ""):
            continue
        text = _text(value)
        if k == 0:
            text = "\n\n".join([text, *(t for t in (_text(_at(record, p)) for p in mapping.joined) if t)])
        turns.append((_role(_at(record, role[1:])) if role.startswith("*") else role, text))
    if mapping.messages:
        turns += [(_role(_at(m, mapping.role)), _text(_at(m, mapping.text))) for m in _at(record, mapping.messages) or [] if isinstance(m, dict)]
    return mapping.name, own, turns


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation, and the spans [start, end) of its code points under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\\n", "\\\\n").replace("\n", "\\n") + "\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, rest = part.partition("\n")
        role = re.sub(r"(\\?)\\n", lambda m: "\\n" if m[1] else "\n", head)
        turns.append((unescape(role), unescape(rest[:-len(END) - 1])))
    return turns


def format_records(df: DataFrame, *, id_column: str = "conv_id", record_column: str = "record", layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """Format JSON records of any known layout.

    Returns (conv_id, schema, layout, formatted, loss_spans array<array<int>>):
    the schema fingerprint, the mapping's name (null: none fits), the text and
    its loss mask.
    """

    def run(columns):
        out = {"conv_id": columns["conv_id"], "schema": [], "layout": [], "formatted": [], "loss_spans": []}
        for raw in columns["record"]:
            try:
                record = json.loads(raw) if raw else None
            except ValueError:
                record = None
            layout, schema, turns = canonical_turns(record, layouts)
            text, spans = render(turns)
            for name, value in (("schema", schema), ("layout", layout), ("formatted", text), ("loss_spans", [list(s) for s in spans])):
                out[name].append(value)
        return out

    kind = df.schema[id_column].dataType.simpleString()
    return row_map(df.select(F.col(id_column).alias("conv_id"), F.col(record_column).alias("record")), run,
                   f"conv_id {kind}, schema string, layout string, formatted string, loss_spans array<array<bigint>>")


def gather_turns(df: DataFrame, *, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One JSON record of messages per conversation from rows of turns.

    Turns stand in order of turn, then role and text; null turns come first.
    Repeated rows stay repeated. A conversation is one record of the output, so
    its rows meet; the number of conversations is free.
    """
    turn = F.struct(F.col(turn_column).alias("turn"), F.col(role_column).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("content"))
    gathered = df.groupBy(F.col(id_column).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), t["content"].alias("content")))
    return gathered.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the text and its mask alone."""

    def run(columns):
        out = {name: [] for name in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, spans in zip(columns["formatted"], columns["loss_spans"]):
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in spans)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest())
            out["formatted_chars"].append(len(text))
        return {"conv_id": columns["conv_id"], "layout": columns["layout"], **out}

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return row_map(formatted.select("conv_id", "layout", "formatted", "loss_spans"), run,
                   f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, layout string")

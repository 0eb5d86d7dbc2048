"""Chat formatting: a visitor flattens typed content parts into text with ordered placeholders, and a template marks turns.

A turn is `<|role|>text</s>`. Its content is one text, or a list of parts of type text, image, audio or document; each
part other than text becomes a placeholder `<|type:n|>`, n counting the turn's attachments, and is recorded with its
reference, its place in the turn and the number of tokens it expands to. Control strings inside texts (any `<|`, `<s>`,
`</s>`, `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`) get a backslash after their first character, one more if they have
some already, so that unescaping is exact and no text can open or close a turn.

Turns are formatted one by one, before any shuffle; conversations are then dealt out by id, sorted by turn within
partitions, and folded as a stream, so a conversation of any length takes constant memory.

Typed contents that aren't well formed are defined too: text that is no JSON is one text, a part of unknown type becomes the
placeholder `unknown`, a null part is nothing, and a measure that is no number counts as 0 (any attachment is one token at
least).

Cases: a null role or text is empty; a null turn comes first; equal turns are ordered by role, then text; rows with a
null conversation id are one conversation; repeated rows are turns of their own. Columns other than those named are not
read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, tidy

_TAIL = r"(?:\||/?s>|/?INST\]|</?SYS>>)"
_TO_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAIL})")
_TO_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAIL})")
_TURN = re.compile(r"<\|([^|]*)\|>(.*)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _TO_UNESCAPE.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("|", "\\p")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "|" if m[1] == "p" else m[1], role, flags=re.DOTALL)


def measure(part: dict, name: str) -> float:
    """A part's measure as a number of 0 or more; what isn't one counts as 0."""
    try:
        x = float(part.get(name) or 0)
    except (TypeError, ValueError):
        return 0.0
    return x if 0 <= x < 1e12 else 0.0


def parts_of(text: str) -> list:
    """The parts of a typed content: a JSON list, or one JSON value as the only part; what isn't JSON is one text."""
    try:
        parts = json.loads(text or "[]")
    except ValueError:
        return [text]
    return parts if isinstance(parts, list) else [parts]


class PartVisitor:
    """Visits the parts of one turn in order; `visit_<type>` returns the text that stands for a part."""

    #: Pixels of an image patch, tokens of a second of audio, tokens of a page.
    patch, per_second, per_page = 14, 25, 400

    def __init__(self):
        self.attachments: list[dict] = []

    def flatten(self, parts: list) -> str:
        out, said = [], []  # texts that follow each other are escaped as one, so that no control string comes from two
        for p in parts:
            kind = p.get("type") if isinstance(p, dict) else None
            if kind == "text" or not isinstance(p, dict):
                said.append(self.visit_text(p))
            else:
                out += [escape("".join(said)), getattr(self, f"visit_{kind}" if kind in ("image", "audio", "document") else "visit_unknown")(p)]
                said = []
        return "".join(out) + escape("".join(said))

    def visit_text(self, part) -> str:
        """The text of a part, or of a JSON value that is no part; null is nothing."""
        text = part.get("text") if isinstance(part, dict) else part
        return "" if text is None else text if isinstance(text, str) else json.dumps(text, ensure_ascii=False)

    def visit_image(self, part: dict) -> str:
        return self._placed(part, math.ceil(measure(part, "width") / self.patch) * math.ceil(measure(part, "height") / self.patch))

    def visit_audio(self, part: dict) -> str:
        return self._placed(part, math.ceil(measure(part, "seconds") * self.per_second))

    def visit_document(self, part: dict) -> str:
        return self._placed(part, math.ceil(measure(part, "pages") * self.per_page))

    def visit_unknown(self, part: dict) -> str:
        return self._placed(part | {"type": "unknown"}, 1)

    def _placed(self, part: dict, tokens: int) -> str:
        n = len(self.attachments)
        ref = part.get("ref")
        self.attachments.append({"n": n, "type": part["type"], "ref": ref if ref is None or isinstance(ref, str) else json.dumps(ref), "tokens": max(1, min(int(tokens), 1 << 62))})
        return f"<|{part['type']}:{n}|>"


TURNS = "role string, text string, formatted string, loss_begin int, loss_end int, attachments array<struct<n:int,type:string,ref:string,tokens:long>>"
_ATTACHMENTS = pa.list_(pa.struct([("n", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turn(role: str, parts: list[dict]) -> tuple[str, int | None, int | None, list[dict]]:
    """The formatted turn, the range of its loss mask in code points (null unless the assistant speaks), its attachments."""
    visitor = PartVisitor()
    head, body = f"<|{escape_role(role)}|>", visitor.flatten(parts)
    mask = (len(head), len(head) + len(body)) if role == "assistant" else (None, None)
    return f"{head}{body}</s>", *mask, visitor.attachments


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay as they are."""
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape_role(found[1]), unescape(found[2])


def format_chat(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", typed: bool = False) -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss_begin, loss_end, attachments) of each row; with typed, the text column holds a JSON list of parts."""
    small_batches(turns.sparkSession)
    names = ["conv_id", "turn", "role", "text", "formatted", "loss_begin", "loss_end", "attachments"]

    def run(batches):
        for b in batches:
            roles, texts = ([x or "" for x in b.column(i).to_pylist()] for i in (2, 3))
            done = [format_turn(r, parts_of(t) if typed else [{"type": "text", "text": t}]) for r, t in zip(roles, texts, strict=True)]
            cols = list(zip(*done, strict=True)) if done else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), _ATTACHMENTS), strict=True))], names)

    kinds = (turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    schema = "conv_id {}, turn {}, ".format(*kinds) + TURNS
    return turns.select(conv_col, turn_col, role_col, text_col).mapInArrow(tidy(run), schema)


def fold_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachments, attachment_tokens), read back from the formatted turns of each conversation in order."""
    small_batches(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, state = None, None

        def closed():
            return (now[0], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["attached"], state["tokens"])

        def packed(rows, conv_type):
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachments", "attachment_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

        conv_type = None
        for b in batches:
            out, conv_type = [], b.column(0).type
            for conv, text, begin, end, parts in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if now != (conv,):
                    if now is not None:
                        out.append(closed())
                    now, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "attached": 0, "tokens": 0}
                role, said = read_turn(text)
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
                state["chars"] += len(text)
                if begin is not None:
                    learnt = unescape(text[begin:end])
                    state["loss_chars"] += len(learnt)
                    state["loss"].update(learnt.encode())
                state["attached"] += len(parts)
                state["tokens"] += sum(p["tokens"] for p in parts)
            if out:
                yield packed(out, conv_type)
        if now is not None:
            yield packed([closed()], conv_type)

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments long, attachment_tokens long"
    return dealt.select("conv_id", "formatted", "loss_begin", "loss_end", "attachments").mapInArrow(tidy(run), schema)

r"""Chat formatting with typed content parts.

A visitor flattens a turn's parts: neighbouring text parts become one run of
escaped text, every image, audio or document part one placeholder, in order.
The attachment list holds each placeholder's kind, reference, position in the
formatted turn and the tokens that it stands for.

A turn is ``<turn>ROLE</role>BODY</turn>\n``. Inside roles and texts every
backslash is doubled and a backslash is put after the ``<`` of a control
string, so no control string ever appears in escaped text and ``\x -> x``
undoes it.

Defined cases: null text or role is empty; a null or unknown part kind is
read as text; rows are ordered by (turn, role, text) with nulls last, so ties
and repeated rows have one order; a null conversation id is a conversation.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import in_arrow, partitions, pick

TURN, ROLE_END, TURN_END = "<turn>", "</role>", "</turn>\n"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
LOSS_ROLES = ("assistant",)
_CONTROL = re.compile(r"\\|<(?=(?:turn|/turn|/role|image|audio|document)>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN_FORM = re.compile(r"<turn>(.*?)</role>(.*)</turn>\n", re.S)
_PLACEHOLDER = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))

ATTACHMENT = "kind string, ref string, position long, tokens long"
FORMATTED = f"conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, attachments array<struct<{ATTACHMENT}>>, attachment_tokens long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens one turn's parts; a part is a dict with ``type`` and what its kind needs.

    Sizes: ``width`` and ``height`` of an image (one token a patch), seconds
    of an audio part (tokens a second), ``pages`` of a document (tokens a
    page). A missing size counts as the least size.
    """

    def __init__(self, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 1024):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.run: list[str] = []
        self.out: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        getattr(self, f"visit_{kind}", self.visit_text)(part) if kind in PLACEHOLDERS else self.visit_text(part)

    def visit_text(self, part: dict) -> None:
        self.run.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        w, h = (-(-max(1, part.get(k) or 1) // self.patch) for k in ("width", "height"))
        self._place("image", part, w * h)

    def visit_audio(self, part: dict) -> None:
        self._place("audio", part, max(1, -int(-(part.get("seconds") or 0.0) * self.audio_rate // 1)))

    def visit_document(self, part: dict) -> None:
        self._place("document", part, max(1, part.get("pages") or 1) * self.page_tokens)

    def _flush(self) -> None:
        if self.run:
            self._emit(escape("".join(self.run)))
            self.run = []

    def _emit(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _place(self, kind: str, part: dict, tokens: int) -> None:
        self._flush()
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "position": self.length, "tokens": tokens})
        self._emit(PLACEHOLDERS[kind])

    def body(self) -> str:
        self._flush()
        return "".join(self.out)


def format_turn(role: str | None, parts: list[dict], loss_roles=LOSS_ROLES, **sizes) -> dict:
    visitor = PartVisitor(**sizes)
    for part in parts:
        visitor.visit(part)
    body, head = visitor.body(), f"{TURN}{escape(role or '')}{ROLE_END}"
    masked = (role or "") in loss_roles
    for a in visitor.attachments:
        a["position"] += len(head)
    return {"formatted": f"{head}{body}{TURN_END}", "loss_start": len(head) if masked else None,
            "loss_end": len(head) + len(body) if masked else None, "attachments": visitor.attachments,
            "attachment_tokens": sum(a["tokens"] for a in visitor.attachments)}


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn (placeholders left out)."""
    m = _TURN_FORM.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(_PLACEHOLDER.sub("", m[2]))


def format_turns(rows: DataFrame, loss_roles=LOSS_ROLES, **sizes) -> DataFrame:
    """One formatted row a turn, from (conv_id, turn, role, text) or (conv_id, turn, role, parts).

    ``parts`` is an array of structs (type, text, ref, width, height, seconds,
    pages; absent fields are null). Each row is formatted on its own, so a
    conversation of any length is spread over all tasks. ``loss_start`` and
    ``loss_end`` are code-point positions in ``formatted``, null outside the
    loss mask.
    """
    names = [c.lower() for c in rows.columns]
    content = "parts" if "parts" in names else "text"
    own = pick(rows, "conv_id", "turn", "role", content)

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()),
                            ("loss_start", pa.int64()), ("loss_end", pa.int64()),
                            ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))),
                            ("attachment_tokens", pa.int64())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = [{"type": "text", "text": r["text"]}] if content == "text" else [p or {} for p in r["parts"] or []]
                out.append({"conv_id": r["conv_id"], "turn": r["turn"], "role": r["role"], **format_turn(r["role"], parts, loss_roles, **sizes)})
            yield pa.RecordBatch.from_pylist(out, schema)
    return in_arrow(own, run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted turns: counts and digests.

    Turns are dealt by conversation, sorted, and read as a stream with a
    running digest, so a conversation of any length needs no more memory than
    one batch.
    """
    text = F.col("formatted")
    ordered = (formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end")
               .repartition(partitions(formatted.sparkSession), "conv_id")
               .sortWithinPartitions(F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), text.asc()))

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, state = (), None

        def done():
            return {"conv_id": now[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                    "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now != (r["conv_id"],):
                    if now:
                        out.append(done())
                    now, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = read_turn(r["formatted"])
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                state[4] += len(r["formatted"])
                if r["loss_start"] is not None:
                    learnt = unescape(_PLACEHOLDER.sub("", r["formatted"][r["loss_start"]:r["loss_end"]]))
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([done()], schema)
    return in_arrow(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

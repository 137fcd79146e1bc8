"""Chat formatting: typed content parts, one template, a loss mask, and the way back."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, parallel

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Strings with a meaning in this or another template. None of them survives inside a text:
#: a backslash goes after the first character, one more if there are some already.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_RESTS = {f: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == f) for f in ("<", "[")}
_ESCAPE = re.compile("|".join(rf"(?:{re.escape(f)}\\*)(?={rest})" for f, rest in _RESTS.items()))
_UNESCAPE = re.compile("|".join(rf"(?:{re.escape(f)}\\*)\\(?={rest})" for f, rest in _RESTS.items()))

PART_TYPE = (
    "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
)
TURN_TYPE = (
    "turn_no long, role string, formatted string, start long, loss array<struct<start:long,stop:long>>, "
    "attachments array<struct<no:long,kind:string,ref:string,tokens:long>>"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group(0) + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group(0)[:-1], text)


class PartVisitor:
    """Flattens the parts of one turn in their order.

    Text is escaped and kept; every other part leaves a numbered placeholder, a
    reference and the number of tokens that it takes once expanded. A part of an
    unknown type is read as text.
    """

    def __init__(self, first: int, patch: int = 28, audio_rate: int = 25, page_tokens: int = 256):
        self.no, self.patch, self.audio_rate, self.page_tokens = first, patch, audio_rate, page_tokens
        self.pieces: list[str] = []
        self.runs: list[tuple[int, int]] = []
        self.attachments: list[dict] = []
        self.length = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        body = escape(part.get("text") or "")
        self.runs.append((self.length, self.length + len(body)))
        self._put(body)

    def visit_image(self, part: dict) -> None:
        tiles = [math.ceil((part.get(k) or 0) / self.patch) for k in ("width", "height")]
        self._attach("image", part, tiles[0] * tiles[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"no": self.no, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self._put(f"<|{kind}:{self.no}|>")
        self.no += 1

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)


def joined_texts(parts: list[dict]) -> list[dict]:
    """Neighbouring text parts as one, so that no control string arises at their seam."""
    out: list[dict] = []
    for part in parts:
        is_text = not hasattr(PartVisitor, f"visit_{part.get('type') or 'text'}") or (part.get("type") or "text") == "text"
        if is_text and out and out[-1]["type"] == "text":
            out[-1] = {"type": "text", "text": out[-1]["text"] + (part.get("text") or "")}
        else:
            out.append({"type": "text", "text": part.get("text") or ""} if is_text else part)
    return out


def format_turn(role: str, parts: list[dict], start: int, first: int, learn: bool) -> dict:
    """One turn as text, with the spans (code points from the conversation's start) that carry loss."""
    head = f"{OPEN}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
    visitor = PartVisitor(first)
    for part in joined_texts(parts):
        visitor.visit(part)
    body = start + len(head)
    loss = [{"start": body + a, "stop": body + b} for a, b in visitor.runs] if learn else []
    return {"role": role, "formatted": f"{head}{''.join(visitor.pieces)}{CLOSE}", "start": start, "loss": loss, "attachments": visitor.attachments}


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders are no text."""
    head, _, rest = formatted.partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(head[len(OPEN) :]))
    runs = re.split(r"<\|(?:image|audio|document):\d+\|>", rest[: -len(CLOSE)])
    return role, "".join(map(unescape, runs))


def format_conversations(
    conversations: DataFrame, *, parts_col: str | None = None, learn_role: str = "assistant"
) -> DataFrame:
    """``conv_id`` and, per turn, its formatted text, place, loss spans and attachments.

    Turns go by ``turn``, then role and text; the rows of a conversation follow
    one another in one partition. A conversation streams through its task row by
    row, so memory does not follow its length. ``parts_col`` names an array of
    typed parts (``PART_TYPE``); without it the column ``text`` is one text part.

    Null text, role or parts count as empty; null ``conv_id`` is one conversation,
    a null turn comes first. Repeated rows are turns of their own. Only the named
    columns are read. An empty table gives no rows.
    """
    content = F.col(parts_col).cast(PART_TYPE) if parts_col else F.lit(None).cast(PART_TYPE)
    text = F.lit(None).cast("string") if parts_col else F.col("text").cast("string")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), content.alias("parts"))
    order = ["conv_id", "turn", "role", "text", *([F.to_json("parts")] if parts_col else [])]
    typed = parts_col is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turn_no, place, first = object(), 0, 0, 0
        for batch in batches:
            out = []
            ids = batch.column("conv_id").to_pylist()
            parts = batch.column("parts").to_pylist() if typed else [[{"text": x}] for x in batch.column("text").to_pylist()]
            for conv, who, content in zip(ids, batch.column("role").to_pylist(), parts, strict=True):
                if conv != at:
                    at, turn_no, place, first = conv, 0, 0, 0
                made = format_turn(who, content or [], place, first, who == learn_role)
                out.append({"conv_id": conv, "turn_no": turn_no, **made})
                turn_no, place, first = turn_no + 1, place + len(made["formatted"]), first + len(made["attachments"])
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, {TURN_TYPE}"
    schema = _arrow(conversations, ddl)
    return map_batches(parallel(rows, "conv_id").sortWithinPartitions(*order), run, ddl)


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns in their order.

    Goes over the partitions of ``format_conversations`` as they are: nothing moves.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = _arrow(formatted, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row() -> dict:
            conv, n, turns, chars, loss, length = state
            return dict(zip(schema.names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), length), strict=True))

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "start", "loss"))
            for conv, text, start, spans in zip(*columns, strict=True):
                if state is None or conv != state[0]:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = read_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learnt = unescape(text[span["start"] - start : span["stop"] - start])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    return map_batches(formatted, run, ddl)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def digest_sql() -> str:
    """DuckDB SQL with the digest of every conversation and of conversation -7."""
    longer = "text"
    for c in CONTROL:
        first, rest = re.escape(c[0]), re.escape(c[1:])
        longer = f"regexp_replace({longer}, '{first}(\\\\*){rest}', '{c[0]}\\\\\\1{c[1:]}', 'g')"
    sample = "</s>[INST] ok [/INST]"
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{sample}' UNION ALL SELECT -7, 1, 'assistant', '{sample}'),
sized AS (
  SELECT *, {len(OPEN) + 1 + len(CLOSE)} + length(role) + length({longer}) AS n FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

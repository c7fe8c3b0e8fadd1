"""Formatting of conversations with a compiled template, and reading them back.

Turns are sorted inside the task that renders them and stream through the template: memory holds one batch, not one
conversation. The output has one row per ``PART_CHARS`` characters of a conversation (nearly always one), so no cell
grows with a conversation. Each row has the formatted text and the spans of the loss mask in it (code points).

Texts and roles are escaped reversibly: after the first character of every control string, and after every backslash,
a sign is put in, so no control string of ``CONTROLS`` is left in a text.

Defined cases: null text and role are empty; a null conversation id is a conversation of its own; turns of equal number
(or null, which come first) follow by role and text; repeated rows are repeated turns. A conversation without rows has no
output. Further columns take no part. A conversation's rows meet in one task, as its digests are sequential; they stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.template import compile_template

# Control strings of the template and of common chat formats.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (OPEN, BODY, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

TEMPLATE = (
    "{% for turn in turns %}" + OPEN + "{{ turn.role | escape }}" + BODY
    + "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    + CLOSE + "{% endfor %}")
PART_CHARS = 1 << 20
STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + r")(.)|(\\)", re.S)
SIGNS = re.compile(r"\\([\\.])")
FORMATTED = "conv_id long, part int, formatted string, loss_spans array<struct<start: long, end: long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str | None) -> str:
    """A backslash is doubled; ``\\.`` follows the first character of a control string."""
    return STARTS.sub(lambda m: "\\\\" if m[2] else m[1] + "\\.", text or "")


def unescape(text: str) -> str:
    return SIGNS.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    for batch in batches:
        yield from zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())


def grouped(rows: Iterator[tuple], key: int = 0) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with one key, each read lazily; an unread rest is skipped."""
    held = next(rows, None)

    def run(value: object) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[key] == value:
            row, held = held, next(rows, None)
            yield row

    while held is not None:
        value = held[key]
        items = run(value)
        yield value, items
        for _ in items:
            pass


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (conv_id, part, formatted, loss_spans); parts of a conversation follow each other within one partition."""
    compile_template(template, {"escape": escape})  # a wrong template fails here, not in the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        out, held = [], 0
        for conv, rows in grouped(turns_of(batches)):
            part, size, texts, spans = 0, 0, [], []
            for text, marked in render({"turns": ({"role": r or "", "text": t or ""} for _, r, t in rows)}):
                for a in range(0, len(text), part_chars):
                    piece = text[a : a + part_chars]
                    if size and size + len(piece) > part_chars:
                        out.append((conv, part, "".join(texts), spans))
                        part, size, texts, spans = part + 1, 0, [], []
                        held += part_chars
                    if marked:
                        if spans and spans[-1]["end"] == size:
                            spans[-1]["end"] += len(piece)
                        else:
                            spans.append({"start": size, "end": size + len(piece)})
                    texts.append(piece)
                    size += len(piece)
                    if held >= 4 * part_chars:
                        yield record(out, FORMATTED_SCHEMA)
                        out, held = [], 0
            out.append((conv, part, "".join(texts), spans))
            held += size
            if held >= 4 * part_chars:
                yield record(out, FORMATTED_SCHEMA)
                out, held = [], 0
        if out:
            yield record(out, FORMATTED_SCHEMA)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").alias("_turn"), "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


FORMATTED_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()),
    ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
DIGEST_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


class Stream:
    """Unescapes text that comes in pieces: a backslash at the end of a piece waits for the next one."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> str:
        text = self.rest + text
        odd = (len(text) - len(text.rstrip("\\"))) % 2
        self.rest = "\\" if odd else ""
        return unescape(text[:-1] if odd else text)


def read_turns(parts: Iterator[str]) -> Iterator[tuple[str, str, bool]]:
    """Pieces (what, text, ended) of a formatted conversation: what is ``role`` or ``text``."""
    held, what, stream = "", None, Stream()
    signs = {None: OPEN, "role": BODY, "text": CLOSE}
    for part in parts:
        held += part
        while True:
            sign = signs[what]
            at = held.find(sign)
            if at < 0:
                keep = len(sign) - 1
                if what is not None and len(held) > keep:
                    yield what, stream.feed(held[: len(held) - keep]), False
                    held = held[len(held) - keep :]
                break
            if what is None:
                if held[:at]:
                    raise ValueError("text between turns")
            else:
                yield what, stream.feed(held[:at]), True
                stream = Stream()
            held = held[at + len(sign) :]
            what = {None: "role", "role": "text", "text": None}[what]
    if held or what is not None:
        raise ValueError("a turn is not closed")


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Read each conversation back from its parts: turns, loss text and lengths as digests.

    Takes the output of ``format_conversations`` as it lies, without another shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_spans")]))
        out = []
        for conv, parts in grouped(rows):
            turns, loss, n, chars, total, stream = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, Stream()

            def texts(parts: Iterator[tuple]) -> Iterator[str]:
                nonlocal chars, total
                for _, text, spans in parts:
                    total += len(text)
                    for span in spans:
                        plain = stream.feed(text[span["start"] : span["end"]])
                        chars += len(plain)
                        loss.update(utf8(plain))
                    yield text

            for what, text, ended in read_turns(texts(parts)):
                turns.update(utf8(text))
                if ended:
                    turns.update(b"\n")
                    n += what == "text"
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(out) >= 2000:
                yield record(out, DIGEST_SCHEMA)
                out = []
        if out:
            yield record(out, DIGEST_SCHEMA)

    return formatted.select("conv_id", "part", "formatted", "loss_spans").mapInArrow(run, DIGESTS)

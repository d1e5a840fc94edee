"""Heading-aware chunking of documents.

The size of a chunk depends on all chunks before it, so each document is one
step of an Arrow task; everything around it (pages, times, titles) is made of
columns. Offsets are those of the fragments as they are cut: inside a block that
had to be split they advance by fragment length alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import constants as K
from ..functions.arrow import pieces

_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_NO_END = re.compile(rf"\b(?:{'|'.join(K.ABBREVIATIONS)})\.|\b[A-Z]\.")
_MARK = "\x00"
_END = re.compile(rf"(?:[{K.CJK_TERMINATORS}]+[{re.escape(K.CLOSING_MARKS)}]*|[{re.escape(K.LATIN_TERMINATORS)}](?=\s|$))")


@dataclass
class Piece:
    text: str
    start: int
    end: int
    path: str | None


def sentences(text: str) -> list[str]:
    """CJK terminators end a sentence with the closing marks after them; Latin ones before white space only, abbreviations aside."""
    guarded = _NO_END.sub(lambda m: m.group().replace(".", _MARK), text)
    out, at = [], 0
    for m in _END.finditer(guarded):
        out.append(guarded[at : m.end()])
        at = m.end()
    out.append(guarded[at:])
    return [s for s in (x.replace(_MARK, ".").strip() for x in out) if s]


def hard_split(text: str, size: int) -> list[str]:
    """Parts of at most size characters, cut at the last space or comma of each if that lies in its second half."""
    out, at, end = [], 0, len(text)
    while end - at > size:  # by places, as copies of the rest would take the square of a long line
        head = text[at : at + size]
        cut = max(head.rfind(c) for c in " ，,")
        cut = size if cut < size // 2 else cut
        out.append(head[:cut].strip())
        at += cut
        while at < end and text[at].isspace():
            at += 1
        while end > at and text[end - 1].isspace():
            end -= 1
    return [x for x in [*out, text[at:end]] if x]


def blocks(text: str) -> Iterator[Piece]:
    """Lines that aren't blank, each under the path of the headings above it; headings are no content."""
    stack: list[tuple[int, str]] = []
    offset = 0
    for line in text.split("\n"):
        bare = line.strip()
        if m := _HEADING.match(bare):
            level = len(m[1])
            stack = [h for h in stack if h[0] < level]
            stack.append((level, m[2]))
        elif bare:
            start = offset + len(line) - len(line.lstrip())
            yield Piece(bare, start, start + len(bare), " > ".join(t for _, t in stack) or None)
        offset += len(line) + 1


def fitted(piece: Piece, size: int) -> Iterator[Piece]:
    if len(piece.text) <= size:
        yield piece
        return
    at = piece.start
    for sentence in sentences(piece.text):
        for part in hard_split(sentence, size):
            yield Piece(part, at, at + len(part), piece.path)
            at += len(part)


def tail(chunk: Piece, overlap: int) -> Piece | None:
    """The end of a chunk that the next one begins with: whole words of its last characters."""
    if not overlap or not chunk.text:
        return None
    text = chunk.text[-overlap:]
    if len(chunk.text) > overlap:
        breaks = [i for i in (text.find(" "), text.find("\n")) if i >= 0]
        if breaks and max(breaks) < len(text) - 1:
            text = text[max(breaks) + 1 :]
    text = text.strip()
    return Piece(text, max(0, chunk.end - len(text)), chunk.end, chunk.path) if text else None


def packed(pieces: Iterable[Piece], size: int, overlap: int) -> list[Piece]:
    out: list[Piece] = []
    held: list[Piece] = []
    length = 0

    def flush() -> Piece | None:
        nonlocal held, length
        if not held:
            return None
        out.append(Piece("\n".join(p.text for p in held), held[0].start, held[-1].end, held[0].path))
        held, length = [], 0
        return out[-1]

    for piece in pieces:
        if held and piece.path != held[0].path:
            flush()
        if held and length + len(piece.text) + 1 > size:
            seed = tail(flush(), overlap)
            if seed and len(seed.text) + len(piece.text) + 1 <= size:
                held, length = [seed], len(seed.text)
        held.append(piece)
        length += len(piece.text) + 1
    flush()
    return out


def merged(chunks: list[Piece], size: int, least: int = K.LEAST_CHUNK) -> list[Piece]:
    """Chunks under `least` characters go to the one before, else the one after, if heading and size allow."""
    out: list[Piece] = []
    todo = list(chunks)
    k = 0
    while k < len(todo):
        c = todo[k]
        fits = lambda a, b: a.path == b.path and len(a.text) + len(b.text) + 1 <= size
        if len(c.text) < least and out and fits(out[-1], c):
            out[-1] = Piece(f"{out[-1].text}\n{c.text}", out[-1].start, c.end, c.path)
        elif len(c.text) < least and k + 1 < len(todo) and fits(c, todo[k + 1]):
            todo[k + 1] = Piece(f"{c.text}\n{todo[k + 1].text}", c.start, todo[k + 1].end, c.path)
        else:
            out.append(c)
        k += 1
    return out


def chunks_of(text: str | None, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> list[Piece]:
    return merged(packed((p for b in blocks(text or "") for p in fitted(b, size)), size, overlap), size)


SCHEMA = "doc_id long, chunk_index int, total_chunks int, start_char long, end_char long, heading_path string, section string, text string"


def chunked(docs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """The chunks of every document (doc_id, text); a document without content has none. A task holds the chunks of some documents at a time, whatever comes in one batch."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = chunks_of(text, size, overlap)
                rows += [(doc, i, len(made), c.start, c.end, c.path, c.path.split(" > ")[-1] if c.path else None, c.text) for i, c in enumerate(made)]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def split_hard(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and parts of texts (doc_id, text): each at most size characters. Where a part ends depends on the one before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hard_split(t or "", size) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "parts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, parts array<string>")

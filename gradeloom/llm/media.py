"""TIFF columns: one row per page, and texts stored losslessly as 8-bit pages.

``tiff_pages`` decodes a binary column into a row per page. Bytes that aren't TIFF, or break off, give one row with
``error`` for the page that failed; pages before it are kept. A null value gives no row. ``text_media`` stores texts as
TIFF files, in several forms (``FORMS``), and ``text_digests`` reads such stored bytes back through ``tiff_pages`` and describes them.

Defined cases of ``text_digests``: a null text is an empty one, and an empty text is one row of 576 bytes 255. Equal texts
give equal values in all columns but the key. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fields, own
from .tiff import DEFLATE, LZW, NONE, PACKBITS, TiffError, pages, write

#: Payload bytes come in rows of this width; a page has at most PAGE_ROWS of them.
ROW = 576
PAGE_ROWS = 256
STRIP_ROWS = 64

PAGE_COLUMNS = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"
DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, pages int"
#: Bytes of texts or pages in one Arrow batch.
STEP_BYTES = 1 << 20


def tiff_pages(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """A row per page of every file in ``media_col``, with the columns ``keep``. Pages of a file follow each other in its order."""
    names = [*keep, *(c.split()[0] for c in PAGE_COLUMNS.split(", "))]
    kinds = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string()]

    def decode(batches):
        for batch in batches:
            media, rows, of, held = batch.column(batch.num_columns - 1), [], [], 0

            def flush():
                kept = [batch.column(k).take(pa.array(of, pa.int64())) for k in range(len(keep))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)  # noqa: B023

            for i in range(batch.num_rows):
                raw = media[i].as_py()
                if raw is None:
                    continue
                n = 0
                found = pages(raw)
                while True:  # pages leave the task as they come, so that a long file's are never held together
                    try:
                        p = next(found, None)
                        row = None if p is None else [p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.data.tobytes(), None]
                    except TiffError as e:
                        p, row = None, [n, None, None, None, None, None, None, None, str(e)]
                    if row:
                        rows.append(row)
                        of.append(i)
                        held += len(row[7] or b"")
                        if held >= STEP_BYTES:
                            yield flush()
                            rows, of, held = [], [], 0
                    if p is None:
                        break
                    n += 1
            if rows:
                yield flush()

    return df.select(*map(own, keep), own(media_col)).mapInArrow(decode, fields(df, keep, PAGE_COLUMNS))


def payload(text: str | None) -> tuple[int, np.ndarray]:
    """Bytes of a text and the same padded with 255 to a positive multiple of ROW."""
    raw = (text or "").encode()
    size = max(ROW, -(-len(raw) // ROW) * ROW)
    return len(raw), np.frombuffer(raw.ljust(size, b"\xff"), dtype=np.uint8)


#: How a payload is stored, by its crc32: compression, predictor, tiles (height and width; null: strips). Most are deflated, as the others cost more.
FORMS = [(LZW, 1, None), (PACKBITS, 2, (64, 192)), (NONE, 1, (32, 288)), (LZW, 2, (64, 192)), *[(DEFLATE, 2, None)] * 18, *[(DEFLATE, 1, (128, 192))] * 10]


def store(data: np.ndarray) -> bytes:
    """A TIFF file of a payload: rows of ROW bytes, PAGE_ROWS a page, in the form that its crc32 picks."""
    rows = data.reshape(-1, ROW)
    compression, predictor, tile = FORMS[zlib.crc32(data) % len(FORMS)]
    return write([rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)], compression, predictor, STRIP_ROWS, tile)


class Digest:
    """Digests of a payload that comes page by page."""

    def __init__(self) -> None:
        self.size, self.pages, self.sha, self.tail = 0, 0, hashlib.sha256(), b""
        self.counts, self.steps = np.zeros(256, dtype=np.int64), 0

    def add(self, pixels: bytes) -> None:
        samples = np.frombuffer(pixels, dtype=np.uint8)
        self.size += len(pixels)
        self.pages += 1
        self.sha.update(pixels)
        self.tail = (self.tail + pixels[-32:])[-32:]
        self.counts += np.bincount(samples, minlength=256)
        rows = samples.reshape(-1, ROW)
        self.steps += int((np.maximum(rows[:, 1:], rows[:, :-1]) - np.minimum(rows[:, 1:], rows[:, :-1])).sum(dtype=np.int64))

    def feature(self) -> str:
        """Mean, deviation, mean step between neighbours and shares of eight grey levels, of 8-bit samples."""
        level = np.arange(256)
        mean = int(self.counts @ level) / self.size
        spread = max(0.0, int(self.counts @ (level * level)) / self.size - mean * mean) ** 0.5
        step = self.steps / (self.size // ROW * (ROW - 1))
        levels = ",".join(str(int(1000 * x // self.size)) for x in self.counts.reshape(8, 32).sum(1))
        return f"mean={mean:.3f};sd={spread:.3f};step={step:.3f};levels={levels}"

    def row(self) -> tuple:
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), self.feature(), self.pages


def text_media(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, ``n_bytes`` and the stored file ``media`` of every text."""
    names = [*keep, "n_bytes", "media"]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            first, sizes, media, held = 0, [], [], 0
            for i in range(batch.num_rows):
                n, data = payload(texts[i].as_py())
                sizes.append(n)
                media.append(store(data))
                held += len(data)
                if held >= STEP_BYTES or i + 1 == batch.num_rows:
                    kept = [batch.column(k).slice(first, len(sizes)) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=names)
                    first, sizes, media, held = i + 1, [], [], 0

    return docs.select(*map(own, keep), own(text_col)).mapInArrow(run, fields(docs, keep, "n_bytes long, media binary"))


def text_digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Store every text as TIFF, read the stored bytes back page by page, and digest them.

    A file lives in its own task alone: no step between deals rows out anew, so its pages stay together."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own(text_col).alias("text"))
    stored = text_media(rows, ["doc_id"]).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    names = [*keep, *(c.split()[0] for c in DIGESTS.split(", "))]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32()]

    def digest(batches):
        file, now, done = None, None, []
        for batch in batches:
            columns = [batch.column(k) for k in range(len(keep))]
            page, pixels, error = (batch.column(names_of[c]) for c in ("page", "pixels", "error"))
            for i in range(batch.num_rows):
                if error[i].as_py() is not None:
                    raise TiffError(error[i].as_py())  # what was stored here can be read
                if page[i].as_py() == 0:
                    if now is not None:
                        done.append((*file, *now.row()))
                    file, now = [c[i].as_py() for c in columns], Digest()
                now.add(pixels[i].as_py())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*file, *now.row()), kinds)], names=names)

    found = tiff_pages(stored, "media", keep)
    names_of = {c: k for k, c in enumerate(found.columns)}
    out = found.mapInArrow(digest, fields(stored, keep, DIGESTS))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages")

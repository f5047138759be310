"""Fill-in-the-middle: texts cut at two unit boundaries and put together anew, so that a model learns to write the middle.

A text's units are words with the white space before them; white space at its end is a unit. ``fill_in_middle`` marks each unit's last byte in a bitvector
over the texts of an Arrow slice (``rankselect``): two ranks give a text's number of units, and a select gives the byte where a unit ends. A
second bitvector of the code points' first bytes gives lengths in characters. No text is split into a list of words.
Draws are hashes of a seed and the id, so a text has the same form wherever it is computed.

``restored`` gives the exact text back from output and form.

Defined cases: a null text is an empty one, and an empty text or one that contains a mark stays plain. A null doc_id is drawn as the empty string,
repeated rows have equal results. An empty table gives an empty one. Columns but the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rankselect import BitVector
from .scratch import own
from .textkernel import BLANKS

MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
FORMS = ("plain", "psm", "spm")
#: Bytes of texts whose bitvectors are built at once; a longer text is taken alone.
STEP_BYTES = 1 << 20


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """The first ``n`` 32-bit numbers of the sha256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def cut_points(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, BitVector]:
    """Units of each text, the byte where its prefix and its middle end, and the code points' bitvector.

    ``data`` holds the texts end to end, from ``offsets`` to ``offsets``; ``first`` and ``second`` are draws."""
    starts, ends = offsets[:-1], offsets[1:]
    blank = BLANKS[data]
    last = np.zeros(len(data), dtype=bool)
    last[:-1] = ~blank[:-1] & blank[1:]
    last[ends[ends > starts] - 1] = True
    units, points = BitVector(last), BitVector((data & 0xC0) != 0x80)
    base = units.rank(starts)
    n = units.rank(ends) - base
    a, b = first % (n + 1), second % (n + 1)
    cuts = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at, some = starts.copy(), k > 0
        at[some] = units.select(base[some] + k[some] - 1) + 1
        cuts.append(at)
    return n, cuts[0], cuts[1], points


def _slices(offsets: np.ndarray):
    """First and last row of runs of rows whose texts have about STEP_BYTES."""
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1)
        yield row, end
        row = end


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, units ``n``, ``form``, lengths in code points and the ``output`` of every text.

    Of ``percent`` in a hundred texts, ``spm_percent`` in a hundred put the suffix first (spm), the others the prefix (psm); the rest stay plain."""
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)
    text = F.coalesce(own(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(own(id_col), seed)
    plain = (text == "") | (h3 % 100 >= percent)
    for m in marks:
        plain = plain | F.contains(text, F.lit(m))
    form = F.when(plain, 0).when(h4 % 100 < spm_percent, 2).otherwise(1)

    def run(batches):
        for batch in batches:
            ids, texts, first, second, kind = batch.columns
            texts = texts.cast(pa.large_string())
            _, place, held = texts.buffers()
            offsets = np.frombuffer(place, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(held, dtype=np.uint8) if held else np.zeros(0, dtype=np.uint8)
            first, second, kind = (c.to_numpy(zero_copy_only=False) for c in (first, second, kind))
            for x, y in _slices(offsets):
                at = offsets[x : y + 1] - offsets[x]
                raw = data[offsets[x] : offsets[y]]
                n, a, b, points = cut_points(raw, at, first[x:y], second[x:y])
                raw, out = raw.tobytes(), []
                for k, s, p, m, e in zip(kind[x:y].tolist(), at[:-1].tolist(), a.tolist(), b.tolist(), at[1:].tolist()):
                    if k == 0:
                        out.append(raw[s:e])
                    elif k == 1:
                        out.append(b"".join((prefix_mark, raw[s:p], suffix_mark, raw[m:e], middle_mark, raw[p:m])))
                    else:
                        out.append(b"".join((suffix_mark, raw[m:e], prefix_mark, raw[s:p], middle_mark, raw[p:m])))
                none = kind[x:y] == 0
                begin, mid, over = (points.rank(z) for z in (at[:-1], a, b))
                columns = [ids.slice(x, y - x), pa.array(n, pa.int64()), pa.array(np.take(FORMS, kind[x:y]), pa.string())]
                columns += [pa.array(z, pa.int64(), mask=none) for z in (mid - begin, over - mid)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(own(id_col).cast("long").alias("doc_id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    return rows.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A mark can't overlap another or come up where two parts meet, as none begins as it ends."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks))
    prefix, suffix, middle = F.when(form == "psm", F.get(parts, 1)).otherwise(F.get(parts, 2)), F.when(form == "psm", F.get(parts, 2)).otherwise(F.get(parts, 1)), F.get(parts, 3)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def infill_digests(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``fill_in_middle`` with digests of output and restored text in place of the output."""
    made = fill_in_middle(docs, seed)
    out, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(out, 256).alias("output_sha256"), F.sha2(restored(out, form), 256).alias("restored_sha256"))


#: The same for seed 42, by lists of units.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS u, sha256('42:' || doc_id) AS h FROM documents
), c AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""

"""Personal data in texts: weak labelers, expectation-maximisation and a span classifier, in DataFrame functions alone.

Spans come from two sources. Base spans are exact formats of four kinds with their checks (numbers of an address at most 255,
Luhn's sum, digit counts); they always stay. Candidates are base spans and looser forms (written-out at signs, addresses
of eight groups, digit chains that fail the sum, national phone numbers). Three labelers vote on every candidate with 1, 0 or -1: the format,
a gazetteer (endings, issuers' digits, dialling codes, reserved ranges) and the words before it. Votes are counted over
all texts; expectation-maximisation on those counts, at most 27 a kind, estimates each labeler's reliability and the
share of true candidates. Its posteriors train a logistic classifier over votes, digit counts and separators, and a
looser candidate stays if the classifier gives it at least ``ACCEPT``.

Positions are code points. A text's matches and the pieces between them are taken by one pattern, and their lengths add up
to positions. Every pattern runs in time linear in the text: runs are possessive, and starts inside a run are excluded. So does what
follows: sums and maxima over a text's matches are taken in blocks (``running``), a span's context comes from the piece before it, and
a text that is rewritten is cut into short pieces first.

Defined cases: a null or empty text has no spans. Repeated rows are handled each for itself. A candidate that overlaps a
base span is dropped. ``redact`` keeps all columns; ``n_chars``, if there is one, follows the new text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.arrays import let, running

from .scratch import materialise, own

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.95
CONTEXT = 40

#: Base formats. Equivalent to the plain forms given beside them, without their quadratic time on long runs.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : starts at a run's start or where the last match ended
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Looser forms.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({]dot[\])}] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}

#: A cheap test that must hold for a text to have a match.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}
LOOSE_NEEDS = {
    "email": lambda t: t.rlike(r"[\[({]at[\])}]"),
    "ip": lambda t: t.rlike(r":[0-9A-Fa-f]{1,4}:"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),  # numbers without a plus, or that further digits made too long for the base format
}

#: Gazetteers: endings, issuers' first digits, dialling codes, reserved first numbers of addresses.
KNOWN = {
    "email": r"\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0+\.|127\.|255\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^(\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
}

#: Words before a span that speak for its kind, and words that speak against personal data.
CUES = {
    "email": r"(e-?mail|contact|write|reach|correo|courriel|kontakt|avec|mit|con|with)\W*$",
    "ip": r"(ip|host|server|address|login|from)\W*$",
    "card": r"(card|visa|master|credit|payment|karte|carte|tarjeta)\W*$",
    "phone": r"(phone|tel|call|mobile|fax|telefon|appel|llam\w*)\W*$",
}
AGAINST = r"(version|isbn|order|serial|section|release|part|ref|no|nr|id)\W*$"

SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
#: Code points in a piece of a text that is cut at many places.
PIECE = 512


def located(text: Column, pattern: str, needs: Column) -> Column:
    """Leftmost matches that don't overlap: an array of start, end (exclusive), value and up to CONTEXT code points ``before``,
    as far as the match before."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(values, lambda v: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(v)).alias("piece"), v.alias("value")))

    def place(x: Column, at: Column) -> Column:
        start = at + F.length(x["piece"])
        before = F.lower(F.substring(x["piece"], -CONTEXT, CONTEXT))
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), before.alias("before"))

    def all_of(xs: Column) -> Column:
        sizes = F.transform(xs, lambda x: F.length(x["piece"]) + F.length(x["value"]))
        return F.zip_with(xs, let(sizes, lambda n: running(n, lambda a, b: a + b)), place)

    return F.when(needs, let(pairs, all_of)).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True if the digits' Luhn sum is a multiple of 10."""
    from_last = F.split(F.reverse(digits(value)), "")

    def worth(d: Column, i: Column) -> Column:
        n = F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(from_last, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda v: F.when(F.length(digits(v)).between(14, 19), luhn(v)).otherwise(False),
    "phone": lambda v: F.length(digits(v)).between(10, 15),
}


def _candidates(spans: Column, kind: str, vote: Column | None = None) -> Column:
    """Spans with their kind's rank, the labelers' votes and the classifier's other features.

    ``vote`` is the format labeler's; null: 1 if the kind's check holds, else -1."""
    rank = KINDS.index(kind)

    def one(s: Column) -> Column:
        value, before = s["value"], s["before"]
        form = vote if vote is not None else F.when(CHECKS[kind](value), 1).otherwise(-1)
        return F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            form.cast("int").alias("form"),
            F.when(value.rlike(KNOWN[kind]), 1).otherwise(-1).alias("listed"),
            F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0).alias("context"),
            F.least(F.length(digits(value)), F.lit(20)).alias("digits"),
            value.rlike(r"[^0-9]").cast("int").alias("parted"),
        )

    return F.transform(spans, one)


def apart(loose: Column, base: Column) -> Column:
    """Spans of ``loose`` that overlap none of ``base``: of the base spans that start before its end, the furthest end isn't past its start."""
    mark = lambda at, kind, place, end: F.struct(at.alias("at"), kind.alias("kind"), place.alias("place"), end.alias("end"))
    asked = F.transform(loose, lambda s, i: mark(s["end"], F.lit(0), i, F.lit(0)))
    given = F.transform(base, lambda s: mark(s["start"], F.lit(1), F.lit(-1), s["end"]))

    def reach(marks: Column) -> Column:
        ends = F.zip_with(marks, running(marks["end"], F.greatest), lambda m, end: F.struct(m["place"].alias("place"), end.alias("end")))
        return F.array_sort(F.filter(ends, lambda e: e["place"] >= 0))

    free = let(let(F.array_sort(F.concat(asked, given)), reach), lambda ends: F.filter(loose, lambda s, i: F.get(ends, i)["end"] <= s["start"]))
    return F.when((F.size(loose) == 0) | (F.size(base) == 0), loose).otherwise(free)


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` (valid base spans by start and kind) and ``loose`` (other candidates apart from them)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs
    for kind in KINDS:  # a column each, so that no pattern runs twice
        df = df.withColumn(f"__{kind}", located(text, PATTERNS[kind], NEEDS[kind](text)))
    for kind in LOOSE:
        df = df.withColumn(f"__loose_{kind}", located(text, LOOSE[kind], LOOSE_NEEDS[kind](text)))
    for kind in KINDS:
        df = df.withColumn(f"__{kind}", _candidates(F.col(f"__{kind}"), kind))
    chains = F.filter("__card", lambda s: (s["form"] < 0) & s["digits"].between(13, 19))
    loose = [chains, *(_candidates(F.col(f"__loose_{k}"), k, F.lit(0)) for k in LOOSE)]
    df = df.withColumn("__base", F.array_sort(F.concat(*(F.filter(f"__{k}", lambda s: s["form"] > 0) for k in KINDS))))
    df = df.withColumn("__loose", F.concat(*loose))
    return df.select(*map(own, docs.columns), F.col("__base").alias("base"), apart(F.col("__loose"), F.col("__base")).alias("loose"))


def estimate(cells: dict[tuple[int, int, int, int], float], rounds: int = 60) -> dict[tuple[int, int, int, int], float]:
    """Posterior of each (kind, format, listed, context) vote pattern by expectation-maximisation on its count.

    Labelers are independent given the truth; the start is the votes' mean, counts are smoothed."""
    post = {c: 1 / (1 + math.exp(-2.0 * sum(c[1:]))) for c in cells}
    for kind in {c[0] for c in cells}:
        own = [c for c in cells if c[0] == kind]
        for _ in range(rounds):
            true = sum(cells[c] * post[c] for c in own)
            total = sum(cells[c] for c in own)
            share = (true + 1) / (total + 2)
            rate: dict[tuple[int, int, int], float] = {}
            for k in (1, 2, 3):
                for v in (-1, 0, 1):
                    hit = sum(cells[c] * post[c] for c in own if c[k] == v)
                    miss = sum(cells[c] * (1 - post[c]) for c in own if c[k] == v)
                    rate[k, v, 1] = (hit + 0.5 + (v > 0)) / (true + 2.5)
                    rate[k, v, 0] = (miss + 0.5 + (v < 0)) / (total - true + 2.5)
            for c in own:
                a = math.log(share) + sum(math.log(rate[k, c[k], 1]) for k in (1, 2, 3))
                b = math.log(1 - share) + sum(math.log(rate[k, c[k], 0]) for k in (1, 2, 3))
                post[c] = 1 / (1 + math.exp(max(-50.0, min(50.0, b - a))))
    return post


def _features(cell: tuple[int, ...]) -> list[float]:
    kind, form, listed, context, size, parted = cell
    own = [float(kind == k) for k in range(len(KINDS))]
    return [*own, form, listed, context, parted, *(x * (size - 12) / 8 for x in own), *(x * form for x in own)]


def fit_classifier(cells: dict[tuple[int, ...], float], post: dict[tuple[int, int, int, int], float], rounds: int = 300) -> dict[tuple[int, ...], float]:
    """Probability of each feature cell, by logistic regression on the posteriors (weights: the cells' counts)."""
    rows = [(c, _features(c), n, post[c[:4]]) for c, n in sorted(cells.items())]
    if not rows:
        return {}
    total = sum(n for _, _, n, _ in rows)
    w = [0.0] * len(rows[0][1])
    for _ in range(rounds):
        slope = [1e-3 * x for x in w]
        for _, f, n, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f))))))
            for i, x in enumerate(f):
                slope[i] += n / total * (p - y) * x
        w = [a - 1.0 * b for a, b in zip(w, slope)]
    return {c: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f)))))) for c, f, _, _ in rows}


def accepted_cells(found: DataFrame) -> list[str]:
    """Feature cells whose candidates stay. What is collected has a row per cell: at most 4 x 27 x 21 x 2."""
    parts = ("rank", "form", "listed", "context", "digits", "parted")
    one = found.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy(*(F.col(f"s.{p}").alias(p) for p in parts)).count()
    cells = {tuple(int(r[p]) for p in parts): float(r["count"]) for r in one.collect()}
    votes: dict[tuple[int, int, int, int], float] = {}
    for c, n in cells.items():
        votes[c[:4]] = votes.get(c[:4], 0.0) + n
    return sorted("/".join(map(str, c)) for c, p in fit_classifier(cells, estimate(votes)).items() if p >= ACCEPT)


def find_spans(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with ``base`` and ``spans`` (base and accepted candidates), arrays of start, rank and end."""
    wanted = docs.select(*map(own, dict.fromkeys([*keep, text_col])))
    found = with_candidates(wanted, text_col).select(*map(own, keep), "base", "loose")
    found = materialise(found, "pii")  # the patterns run once; labelers' counts and the result read this
    cells = accepted_cells(found)
    cell = lambda s: F.concat_ws("/", *(s[p].cast("string") for p in ("rank", "form", "listed", "context", "digits", "parted")))
    extra = F.filter("loose", lambda s: cell(s).isin(cells)) if cells else F.filter("loose", lambda s: F.lit(False))
    place = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return found.select(*map(own, keep), place(F.col("base")).alias("base"), F.array_sort(place(F.concat("base", extra))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """A row per document: counts of base spans, their digest, and all spans."""
    found = find_spans(docs.select("doc_id", "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; overlapping spans become one."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(0).alias("__"), *map(own, others))  # names can't clash inside
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    found = find_spans(rows, ["row", "text"])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text, spans = F.col("text"), F.col("spans")

    def rewrite(pieces: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            few = F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)
            return F.when(a < b, F.substring(F.array_join(few, ""), a - first * PIECE + 1, b - a)).otherwise("")

        def put(s: Column, end: Column) -> Column:  # ``end``: how far the spans before reach
            return F.when(s["start"] < end, "").otherwise(F.concat(part(end, s["start"]), F.get(names, s["rank"])))

        done = F.array_join(let(running(spans["end"], F.greatest), lambda ends: F.zip_with(spans, ends, put)), "")
        return F.concat(done, part(F.array_max(spans["end"]), F.length(text)))

    clean = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), rewrite)
    hit = F.size("spans") > 0
    out = found.select("row", hit.alias("hit"), F.when(hit, clean).otherwise(text).alias("clean"))
    new = {c: F.col("clean") if c == text_col else F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return out.select(*(v.alias(c) for c, v in new.items()))


def base_digests(docs: DataFrame) -> DataFrame:
    """The part of ``span_digests`` that is exact formats and checks alone: counts of base spans and their digest."""
    return span_digests(docs).drop("spans")


#: The same by plain patterns, in DuckDB's SQL.
BASE_SQL = r"""
WITH kinds(kind, rank, pattern) AS (VALUES
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  ('ip', 1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  ('card', 2, '[0-9]([\x20-]?[0-9])+'),
  ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')
), hits AS (
  SELECT doc_id, kind, rank, CASE rank
      WHEN 0 THEN string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') WHEN 1 THEN string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')
      WHEN 2 THEN string_split_regex(text, '[0-9]([\x20-]?[0-9])+') ELSE string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') END AS pieces,
    CASE rank
      WHEN 0 THEN regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') WHEN 1 THEN regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')
      WHEN 2 THEN regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+') ELSE regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') END AS found
  FROM documents, kinds WHERE text IS NOT NULL
), places AS (
  SELECT doc_id, kind, rank, found, pieces, unnest(range(1, len(found) + 1)) AS i FROM hits
), spans AS (
  SELECT doc_id, kind, rank, found[i] AS v, regexp_replace(found[i], '[^0-9]', '', 'g') AS d,
    list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS a FROM places
), good AS (
  SELECT doc_id, kind, rank, a::BIGINT AS a, (a + length(v))::BIGINT AS b FROM spans WHERE CASE rank
    WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 2 THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda k:
      CASE WHEN k % 2 = 0 THEN substr(d, length(d) - k, 1)::INTEGER ELSE 2 * substr(d, length(d) - k, 1)::INTEGER - CASE WHEN substr(d, length(d) - k, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(d) BETWEEN 10 AND 15 END
), told AS (
  SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS t,
    count(*) FILTER (WHERE rank = 0) AS e, count(*) FILTER (WHERE rank = 1) AS i, count(*) FILTER (WHERE rank = 2) AS c, count(*) FILTER (WHERE rank = 3) AS p FROM good GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(t, '')) AS base_sha256
FROM documents LEFT JOIN told ON told.doc_id = documents.doc_id
"""

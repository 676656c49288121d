"""Personal data by weak supervision, with DataFrame functions only.

Wide patterns propose candidate spans inside each row. Five labelers vote on each (+1, 0, -1): a strict pattern, a
checksum or range, a gazetteer, words of the context, and the span's borders. Votes are counted by pattern, a table whose
size has a fixed bound. Expectation-maximisation over those counts estimates how reliable each labeler is, without labels;
its posteriors train a logistic span classifier on votes and shape, whose weights are then literals of a column
expression. Spans of the base kinds that pass their checks always stay; the classifier decides on the other candidates.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import materialize, table

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("email_written", "phone_local", "iban", "national_id", "name", "secret")

# The base patterns, with possessive loops and a look at the place before, so that no text makes them slow or deep:
# a match can only begin where a run of its characters begins or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA_PATTERNS = {
    "email_written": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,24}+",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}+(?: [A-Z][a-z]{1,30}+)?",
    "secret": r"(?<![A-Za-z])(?i:token|secret|password|passwd|api[_ ]?key|access[_ ]?key) {0,3}[:=] {0,3}[\x22']?[A-Za-z0-9_/+=-]{12,256}+[\x22']?",
}
ANY_EXTRA = "|".join(f"(?:{p})" for p in EXTRA_PATTERNS.values())

GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\.|127\.|169\.254|192\.168|22[4-9]|23|24|25)",
    "card": r"^(?:3[47]|4|5[1-5]|2[2-7]|6)",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "email_written": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es)$",
    "phone_local": r"^\(?[2-9]",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "national_id": r"^(?!000|666|9)",
    "name": r" (?:James|John|Mary|Robert|Michael|Anna|Maria|Peter|Paul|Thomas|Laura|David|Sarah|Juan|Jean|Hans)",
    "secret": r"(?i)^(?:token|secret|password|api)",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|correo|courriel|kontakt)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login)",
    "card": r"(?i)(?:card|visa|credit|karte|tarjeta|carte)",
    "phone": r"(?i)(?:phone|call|tel|mobil|fax)",
    "email_written": r"(?i)(?:e-?mail|contact|write)",
    "phone_local": r"(?i)(?:phone|call|tel|mobil|fax)",
    "iban": r"(?i)(?:iban|account|bank|konto)",
    "national_id": r"(?i)(?:ssn|social|security|tax)",
    "name": r"(?i)(?:dear|sir|madam|signed|patient|contact)",
    "secret": r"(?i)(?:config|login|export|auth|access|=|:)",
}
AGAINST = r"(?i)(?:version|isbn|example of|chapter|figure|serial|order no)"
CONTEXT_CHARS = 40
VOTES = ("v_regex", "v_check", "v_gazetteer", "v_context", "v_border")
FOUND = "array<struct<kind:string,start:int,end:int,m:string,left:string,right:string>>"
#: A text is also held in pieces of so many code points, so that a place in it is reached without reading from its start.
PIECE_BITS = 8
PIECE = 1 << PIECE_BITS
#: Places that one running value is kept for.
RUN_BITS = 7


def _before(df: DataFrame, values: str, out: str, zero: Column, op) -> DataFrame:
    """df with `out`: for each place of the array column `values`, op over all values before it, zero at the first.

    A fold copies what it has so far at every step, so no list grows along a text: a value for each run of places, running
    values over the runs, and inside a run the few places before. Columns named more than once are computed once.
    """
    v, n, sums, runs = F.col(values), F.size(values), f"{out}_sums", f"{out}_runs"

    def over(first, last, start):
        return F.aggregate(F.sequence(first, last), start, lambda acc, i: op(acc, F.get(v, i)))

    each = F.transform(F.sequence(F.lit(0), F.shiftright(n - 1, RUN_BITS)), lambda r: over(F.shiftleft(r, RUN_BITS), F.least(F.shiftleft(r + 1, RUN_BITS), n) - 1, zero))
    df = df.withColumn(sums, F.when(n > 0, each).otherwise(F.array().cast("array<int>")))
    start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("all"))
    running = F.aggregate(sums, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
    df = df.withColumn(runs, F.when(F.size(sums) > 0, running).otherwise(F.array().cast("array<int>")))

    def at(i):
        first, run = F.shiftleft(F.shiftright(i, RUN_BITS), RUN_BITS), F.get(F.col(runs), F.shiftright(i, RUN_BITS))
        return F.when(i == first, run).otherwise(over(first, F.greatest(i - 1, first), run))

    return df.withColumn(out, F.when((n > 0) & (F.size(runs) > 0), F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<int>"))).drop(sums, runs)


def _added(acc, x):
    return acc + x


def _located(df: DataFrame, out: str, pattern: str, gate: Column) -> DataFrame:
    """df with `out`: the matches of a pattern in pii_text with their places in code points. The pieces between matches give
    the starts."""
    text, m, p, size, before = F.col("pii_text"), f"{out}_m", f"{out}_p", f"{out}_size", f"{out}_before"
    df = df.withColumn(m, F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>")))
    df = _before(df.withColumn(size, F.zip_with(m, p, lambda x, gap: gap + F.coalesce(F.length(x), F.lit(0)))), size, before, F.lit(0), _added)
    found = F.filter(F.arrays_zip(F.col(m).alias("m"), F.col(p).alias("gap"), F.col(before).alias("before")), lambda x: x["m"].isNotNull())
    spans = F.transform(found, lambda x: F.struct((x["before"] + x["gap"]).alias("start"), (x["before"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))
    return df.withColumn(out, spans).drop(m, p, size, before)


def _free(df: DataFrame, out: str, spans: str, base: str) -> DataFrame:
    """df with `out`: the spans that overlap no base span. In order of their starts, those do that an earlier base reaches or
    that reach the next base."""
    both, reach, next_ = f"{out}_both", f"{out}_reach", f"{out}_next"

    def of(spans_: str, free: int) -> Column:
        return F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), F.lit(free).alias("free"), s["end"].alias("end"), s["m"].alias("m")))

    needed = (F.size(spans) > 0) & (F.size(base) > 0)
    df = df.withColumn(both, F.when(needed, F.array_sort(F.concat(of(base, 0), of(spans, 1)))))
    df = df.withColumn(f"{reach}_of", F.transform(both, lambda x: F.when(x["free"] == 0, x["end"]).otherwise(0)))
    df = _before(df, f"{reach}_of", reach, F.lit(0), F.greatest)
    df = df.withColumn(f"{next_}_of", F.transform(F.reverse(both), lambda x: F.when(x["free"] == 0, x["start"]).otherwise(2**31 - 1)))
    df = _before(df, f"{next_}_of", next_, F.lit(2**31 - 1), F.least)
    all_ = F.arrays_zip(F.col(both).alias("x"), F.col(reach).alias("reach"), F.reverse(next_).alias("next"))
    kept = F.filter(all_, lambda y: (y["x"]["free"] == 1) & (y["reach"] <= y["x"]["start"]) & (y["next"] >= y["x"]["end"]))
    kept = F.transform(kept, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["m"].alias("m")))
    return df.withColumn(out, F.when(needed, kept).otherwise(F.col(spans))).drop(both, reach, next_, f"{reach}_of", f"{next_}_of")


def _pieces(text: Column, needed: Column) -> Column:
    return F.when(needed, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, from its pieces."""

    def part(c):
        first = F.greatest(start - F.shiftleft(c, PIECE_BITS), F.lit(0))
        return F.substring(F.get(pieces, c), first + 1, F.least(end - F.shiftleft(c, PIECE_BITS), F.lit(PIECE)) - first)

    inside = F.transform(F.sequence(F.shiftright(start, PIECE_BITS), F.shiftright(end - 1, PIECE_BITS)), part)
    return F.when(end > start, F.array_join(inside, "")).otherwise("")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _kind_of(m: Column) -> Column:
    out = F.lit("secret")
    for kind, pattern in list(EXTRA_PATTERNS.items())[-2::-1]:
        out = F.when(m.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def candidates(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Append pii_text (null: empty), pii_pieces, pii_base (spans that pass), pii_failed and pii_extra to each row. A span has
    its kind, place and text, and what stands to its left and right. The work grows with the text and its matches.

    Null and empty texts have no spans; rows that repeat are each returned; an empty table gives no rows. Input columns of
    these names, and others that begin with pii_, are replaced or left out.
    """
    added = ["pii_text", "pii_pieces", "pii_base", "pii_failed", "pii_extra"]
    kept = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry) if c not in added]
    t = F.col("pii_text")
    gates = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+"))}
    found = docs.select(*kept, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("pii_text"))
    for kind, pattern in PATTERNS.items():
        gate = t.rlike(pattern) if kind not in gates else gates[kind] & t.rlike(pattern)
        found = _located(found, f"pii_{kind}", pattern, gate)
    found = _located(found, "pii_any", ANY_EXTRA, t.rlike(ANY_EXTRA))
    some = F.size("pii_any") > 0
    for kind in BASE_KINDS:
        some = some | (F.size(f"pii_{kind}") > 0)
    found = found.withColumn("pii_pieces", _pieces(t, some))
    pieces = F.col("pii_pieces")

    def told(kind: Column, s: Column) -> Column:
        left = _between(pieces, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"])
        right = _between(pieces, s["end"], s["end"] + CONTEXT_CHARS)
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), left.alias("left"), right.alias("right"))

    def of(kind: str, keep) -> Column:
        return F.transform(F.filter(f"pii_{kind}", lambda s: keep(kind, s["m"])), lambda s: told(F.lit(kind), s))

    found = found.withColumn("pii_base", F.concat(*[of(k, _passes) for k in BASE_KINDS]))
    found = found.withColumn("pii_failed", F.concat(*[of(k, lambda kind, m: ~_passes(kind, m)) for k in BASE_KINDS]))
    found = _free(found, "pii_free", "pii_any", "pii_base")
    extra = F.transform("pii_free", lambda s: told(_kind_of(s["m"]), s))
    found = found.withColumn("pii_extra", F.when(F.size("pii_free") > 0, extra).otherwise(F.array().cast(FOUND)))
    return found.select(*kept, *added)


def _by_kind(kind: Column, patterns: dict[str, str], value: Column) -> Column:
    out = F.lit(False)
    for k, p in patterns.items():
        out = F.when(kind == k, value.rlike(p)).otherwise(out)
    return out


def _features(s: Column, failed: Column) -> list[Column]:
    """Votes and shape of a span: columns with few values each."""
    kind, m, left, right = s["kind"], s["m"], s["left"], s["right"]
    check = F.when(kind.isin("ip", "card", "phone"), F.when(failed, -1).otherwise(1)).when(kind == "national_id", F.when(m.rlike("-00-|-0000$"), -1).otherwise(1)).otherwise(0)
    border = left.rlike(r"(?:^|[\s(\[<\x22':;,=])$") & right.rlike(r"^(?:$|[\s)\]>\x22'.,;:!?])")
    strict = F.when(failed, -1).when(F.length(m) > 80, -1).when(kind.isin(*BASE_KINDS), 1).otherwise(0)
    share = F.length(_digits(m)) / F.length(m)
    return [
        strict.cast("int").alias("v_regex"),
        check.cast("int").alias("v_check"),
        F.when(_by_kind(kind, GAZETTEER, m), 1).otherwise(-1).alias("v_gazetteer"),
        F.when(_by_kind(kind, CONTEXT, F.concat_ws(" ", left, right)), 1).when(F.concat_ws(" ", left, right).rlike(AGAINST), -1).otherwise(0).alias("v_context"),
        F.when(border, 1).otherwise(-1).alias("v_border"),
        F.least(F.floor(F.length(m) / 8), F.lit(4)).cast("int").alias("f_length"),
        F.floor(share * 3).cast("int").alias("f_digits"),
    ]


FEATURES = (*VOTES, "f_length", "f_digits")
#: Rows of the table of vote and shape patterns at most, at any corpus size: kinds * 3 ** votes * lengths * digit shares.
MOST_PATTERNS = (len(BASE_KINDS) + len(EXTRA_KINDS)) * 3 ** len(VOTES) * 5 * 4


@dataclass
class SpanModel:
    """Reliability of each labeler and weights of the span classifier, by (feature, value); (kind, name) is the bias."""

    reliability: dict[str, tuple[float, float]]
    weights: dict[tuple[str, object], float]

    def logit(self, kind: Column, features: list[Column]) -> Column:
        def lookup(name: str, value: Column) -> Column:
            pairs = [(v, w) for (n, v), w in sorted(self.weights.items(), key=str) if n == name]
            if not pairs:
                return F.lit(0.0)
            return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), value), F.lit(0.0))

        out = lookup("kind", kind)
        for name, value in zip(FEATURES, features, strict=True):
            out = out + lookup(name, value)
        return out


def estimate(rows: list[tuple], rounds: int = 60) -> tuple[list[float], dict[str, tuple[float, float]]]:
    """Expectation-maximisation over (kind, votes, count): posteriors of each row, and P(vote +1 | true), P(vote +1 | false)."""
    post = []
    for _, votes, _ in rows:
        s = sum(votes)
        post.append(1 / (1 + math.exp(-1.5 * s)))
    like: dict[tuple[int, int], tuple[float, float]] = {}
    for _ in range(rounds):
        prior, cast = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: [1.0, 1.0])
        for (kind, votes, n), q in zip(rows, post, strict=True):
            prior[kind][0] += n * q
            prior[kind][1] += n * (1 - q)
            for k, v in enumerate(votes):
                cast[k, v][0] += n * q
                cast[k, v][1] += n * (1 - q)
        totals = {k: [sum(cast[k, v][y] for v in (-1, 0, 1)) for y in (0, 1)] for k in range(len(VOTES))}
        like = {(k, v): (cast[k, v][0] / totals[k][0], cast[k, v][1] / totals[k][1]) for k in range(len(VOTES)) for v in (-1, 0, 1)}
        for i, (kind, votes, _) in enumerate(rows):
            a = math.log(prior[kind][0]) + sum(math.log(like[k, v][0]) for k, v in enumerate(votes))
            b = math.log(prior[kind][1]) + sum(math.log(like[k, v][1]) for k, v in enumerate(votes))
            post[i] = 1 / (1 + math.exp(max(-50, min(50, b - a))))
    return post, {name: like.get((k, 1), (0.5, 0.5)) for k, name in enumerate(VOTES)}


def train(counts: list[tuple], rounds: int = 150, rate: float = 0.5) -> SpanModel:
    """counts: (kind, features, n) over all candidates. The classifier fits the posteriors by gradient descent."""
    if not counts:
        return SpanModel({}, {})
    merged: dict[tuple, int] = defaultdict(int)
    for kind, f, n in counts:
        merged[kind, f[: len(VOTES)]] += n
    rows = [(kind, votes, n) for (kind, votes), n in sorted(merged.items())]
    post, reliability = estimate(rows)
    truth = {(kind, votes): q for (kind, votes, _), q in zip(rows, post, strict=True)}
    weights: dict[tuple[str, object], float] = defaultdict(float)
    items = [([("kind", kind), *zip(FEATURES, f, strict=True)], truth[kind, f[: len(VOTES)]], math.log1p(n)) for kind, f, n in sorted(counts)]
    scale = sum(w for _, _, w in items)
    for _ in range(rounds):
        grad: dict[tuple[str, object], float] = defaultdict(float)
        for keys, q, w in items:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[k] for k in keys)))))
            for k in keys:
                grad[k] += w * (q - p) / scale
        for k, g in grad.items():
            weights[k] += rate * 4 * g - 1e-4 * weights[k]
    return SpanModel(reliability, dict(weights))


def fit_model(found: DataFrame) -> SpanModel:
    """Count vote and shape patterns over all candidates of all rows, then estimate and train on at most MOST_PATTERNS rows.

    Rows that repeat count each; rows without candidates, null texts among them, count for nothing; without any candidate the
    model has no weights and accepts every candidate of a kind beyond the base.
    """

    def told(spans: str, failed: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s.alias("span"), F.lit(failed).alias("failed")))

    spans = found.select(F.explode(F.concat(told("pii_base", False), told("pii_failed", True), told("pii_extra", False))).alias("s"))
    s, failed = F.col("s.span"), F.col("s.failed")
    counted = spans.select(s["kind"].alias("kind"), *_features(s, failed)).groupBy("kind", *FEATURES).count()
    return train([(r["kind"], tuple(r[f] for f in FEATURES), r["count"]) for r in counted.collect()])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apply_model(found: DataFrame, model: SpanModel) -> DataFrame:
    """Append pii_spans: base spans, then accepted others by kind and start; each kind, start, end, m.

    Rows without candidates have none; equal texts have equal spans; an empty table gives no rows; an input column of this
    name is replaced.
    """
    def bare(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"))

    good = F.filter("pii_extra", lambda s: model.logit(s["kind"], _features(s, F.lit(False))) >= 0)
    order = F.array(*[F.lit(k) for k in EXTRA_KINDS])
    ranked = F.array_sort(F.transform(good, lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["m"].alias("m"))))
    extra, base = F.transform(ranked, bare), F.transform("pii_base", bare)
    return found.withColumn("pii_spans", F.when(F.size("pii_extra") > 0, F.concat(base, extra)).otherwise(base))


def redact(docs: DataFrame, *, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets; all columns stay, in order.

    Null texts stay null and empty ones empty. Where spans of two kinds overlap, the earlier one is replaced whole and the
    later one's rest is removed with it. Repeated rows are treated alike. Without candidates the text is unchanged.
    """
    model = model or fit_model(candidates(docs, text_col=text_col, carry=[]))
    # a row carries its text once; the flag tells null texts from empty ones
    marked_null = docs.withColumn("pii_null", F.col(f"`{text_col}`").isNull())
    others = [c for c in docs.columns if c != text_col]
    marked = apply_model(candidates(marked_null, text_col=text_col, carry=[*others, "pii_null"]), model).drop("pii_base", "pii_failed", "pii_extra")
    t, pieces = F.col("pii_text"), F.col("pii_pieces")
    end = F.struct(F.char_length(t).alias("start"), F.char_length(t).alias("end"), F.lit("").alias("kind"))
    by_start = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marked = marked.withColumn("pii_order", F.when(F.size("pii_spans") > 0, F.concat(by_start, F.array(end))))
    marked = _before(marked.withColumn("pii_ends", F.transform("pii_order", lambda s: s["end"])), "pii_ends", "pii_at", F.lit(0), F.greatest)

    def part(x):
        sign = F.when(x["s"]["kind"] == "", "").otherwise(F.concat(F.lit("["), F.upper(x["s"]["kind"]), F.lit("]")))
        return F.when(x["s"]["start"] >= x["at"], F.concat(_between(pieces, x["at"], x["s"]["start"]), sign)).otherwise("")

    clean = F.array_join(F.transform(F.arrays_zip(F.col("pii_order").alias("s"), F.col("pii_at").alias("at")), part), "")
    clean = F.when(F.col("pii_null"), None).when(F.size("pii_spans") > 0, F.when(F.size(pieces) > 0, clean)).otherwise(t)
    return marked.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of base kinds, base_sha256, spans. A null text is empty and has no spans.

    Repeated rows and null ids are each returned; other columns are ignored. An empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = materialize(candidates(slim, carry=["doc_id"]).drop("pii_text", "pii_pieces"), "pii-candidates")
    marked = apply_model(found, fit_model(found))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return marked.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_written(F.col("pii_base")), 256).alias("base_sha256"), _written(F.col("pii_spans")).alias("spans"))


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op10_weak_pii": op10_weak_pii}
ORACLE: dict[str, str] = {}

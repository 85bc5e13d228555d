"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Base patterns and wider ones give candidates. Four labelers vote on each with 1, -1 or 0 (no opinion): its shape,
a gazetteer, the words before it, and a check of its content. Expectation-maximisation over the histogram of vote
patterns estimates how reliable each labeler is, and so how likely each pattern is personal data; these soft
labels train a classifier over features of spans (naive Bayes), again from a histogram. Both histograms are bounded
by the number of patterns and features, whatever the number of documents. Base spans always stay; the
classifier decides on the wider candidates.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

SPANS = "array<struct<kind:string,start:int,end:int,hit:string,before:string>>"
NEAR = 40  # characters before a span that labelers see
LOCAL = "A-Za-z0-9._%+-"
#: Base patterns, written so that a long run is not tried anew from each of its characters: a match can only
#: start where its first run starts or where the match before has ended, and what is matched is never given back. Of runs
#: of digits, those of 13 and more are worth a vote, so shorter ones are no matches.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates: an address with "at" in words, a number in groups without a plus, a long hexadecimal string.
WIDE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![A-Za-z0-9+.,-])(?:\([0-9]{2,5}\)[\x20]?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){0,3}+(?![A-Za-z0-9@])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
}
NEEDS = {"email": "@", "phone": "+"}  # base patterns that need a certain character
ORDER = ["email", "ip", "card", "phone", "secret"]
#: Gazetteers.
TLDS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|it|nl|ch|at|be|ca|au"
KEY_WORDS = "token|secret|password|passwd|api[_ -]?key|key|bearer|auth|credential"
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CUES = "phone|tel|telephone|call|mobile|cell|fax|mail|e-mail|email|contact|reach|card|visa|mastercard|credit|ip|host|server|address|from|token|secret|password|key|at|="
AGAINST = "version|ver|v|license|page|chapter|section|no|isbn|issn|year|since|copyright"
LUHN = "aggregate(transform(sequence(1, length({d})), i -> int(substr({d}, -i, 1)) * if(i % 2 = 0, 2, 1)), 0, (a, v) -> a + if(v > 9, v - 9, v)) % 10 = 0"


def digits(x: str = "x.hit") -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def valid(kind: str) -> str:
    """SQL: whether a match x of a base pattern counts."""
    n = f"length({digits()})"
    return {
        "email": "true",
        "ip": "forall(split(x.hit, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(int(nullif(right(ltrim('0', p), 3), '')), 0) <= 255)",
        "card": f"{n} between 16 and 19 and {LUHN.format(d=digits())}",
        "phone": f"{n} between 8 and 15",
        "secret": "true",
    }[kind]


def matches(kind: str, pattern: str) -> str:
    """SQL: leftmost non-overlapping matches of a pattern in text, with places in code points, end exclusive, and the characters
    before them.

    Places are sums of the lengths before. They are summed in chunks of about sqrt(n) matches, so that nothing grows or
    is counted off match by match over a dense text."""
    found = f"""filter(zip_with(split(text, r'{pattern}'), regexp_extract_all(text, r'{pattern}', 0), (g, h) -> struct(length(g) as n, right(g, {NEAR}) as g, h as h)), x -> x.h is not null)"""
    start, end = "a.at + x.n", "a.at + x.n + length(x.h)"
    step = f"""struct({end} as at, right(concat(a.near, x.g, x.h), {NEAR}) as near,
        concat(a.out, array(struct('{kind}' as kind, {start} as start, {end} as end, x.h as hit, right(concat(a.near, x.g), {NEAR}) as before))) as out)"""
    # what stands before a chunk: its last NEAR matches hold at least so many characters
    near = f"right(array_join(transform(slice(i, greatest(1, o.k - {NEAR} + 1), least({NEAR}, o.k)), x -> concat(x.g, x.h)), ''), {NEAR})"
    each = f"aggregate(c, cast(struct(o.at, {near}, array()) as struct<at:int,near:string,out:{SPANS}>), (a, x) -> {step}, a -> a.out)"
    before = """aggregate(cs, array(struct(0 as k, 0 as at)), (b, c) -> concat(b, array(struct(element_at(b, -1).k + size(c) as k,
        element_at(b, -1).at + aggregate(c, 0, (a, x) -> a + x.n + length(x.h)) as at))))"""
    return f"transform(array({found}), i -> flatten(transform(array({chunks('i')}), cs -> zip_with(cs, slice({before}, 1, size(cs)), (c, o) -> {each}))[0]))[0]"


def chunks(items: str) -> str:
    """SQL: an array cut into about sqrt(n) chunks of so many."""
    return f"transform(array({items}), q -> if(size(q) = 0, array(), transform(sequence(0, size(q) - 1, int(ceil(sqrt(size(q))))), k -> slice(q, k + 1, int(ceil(sqrt(size(q))))))))[0]"


def when_found(kind: str, pattern: str, need: str) -> str:
    return f"case when {need} then if(text rlike r'{pattern}', {matches(kind, pattern)}, cast(array() as {SPANS})) else cast(array() as {SPANS}) end"


#: SQL: votes on a candidate x with x.kind, x.hit, x.before (the characters before it, in lower case).
VOTES = {
    "shape": f"""case x.kind when 'email' then if(x.hit rlike r'^[A-Za-z0-9][{LOCAL}]*', 1, -1) when 'ip' then if(x.hit rlike r'^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$', 1, -1)
        when 'card' then if(length({digits()}) = 16, 1, -1) when 'phone' then if(length({digits()}) between 9 and 13 and x.hit rlike r'[ ().-]', 1, -1)
        else if(length(x.hit) in (32, 40, 64, 128), 1, -1) end""",
    "gazetteer": f"""case x.kind when 'email' then if(lower(x.hit) rlike r'[.) \\]]({TLDS})$', 1, -1) when 'ip' then if(x.hit rlike r'^(0|255)[.]', -1, 0)
        when 'card' then if(x.hit rlike '^[3-6]', 1, -1) when 'phone' then case when x.hit rlike r'^[+]({CALLING_CODES})' then 1 when x.hit rlike r'^[(]?0|^[(][2-9]' then 1 when x.hit rlike r'^[+]' then -1 else 0 end
        else if(x.before rlike r'({KEY_WORDS})', 1, 0) end""",
    "context": f"case when x.before rlike r'(^|[^a-z])({CUES})[^a-z0-9]*$' then 1 when x.before rlike r'(^|[^a-z])({AGAINST})[^a-z0-9]*$' then -1 else 0 end",
    "content": f"""case x.kind when 'email' then if(x.hit rlike r'[.][.]', -1, 1) when 'ip' then if({valid('ip')}, 1, -1) when 'card' then if({valid('card')}, 1, -1)
        when 'phone' then if({valid('phone')}, 1, -1) else if(size(array_distinct(split(x.hit, ''))) >= 8 and x.hit rlike '[a-f]' and x.hit rlike '[0-9]', 1, -1) end""",
}
#: SQL: features of a candidate, each with few values.
FEATURES = {
    "kind": "concat(x.kind, if(x.wide, '~', ''))",
    "digits": f"cast(least(20, length({digits()})) as string)",
    "length": "cast(least(16, int(log2(length(x.hit)) * 3)) as string)",
    "marks": "regexp_replace(substr(regexp_replace(x.hit, '[A-Za-z0-9]', ''), 1, 3), '[^-+(). @]', '_')",
    "cue": VOTES["context"].replace("then 1 ", "then 'for' ").replace("then -1 ", "then 'against' ").replace("else 0 ", "else 'none' "),
    "edge": "case when x.before rlike r'[(\\[{]$' then 'bracket' when x.before rlike '[\"=:]$' then 'mark' when x.before rlike r'\\s$' then 'space' when x.before = '' then 'start' else 'other' end",
}


def candidates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base (valid base spans), tried (all candidates with votes and features), own (carried columns); one row for each of docs."""
    own = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), own.alias("own"))
    has_digit = "text rlike '[0-9]'"
    for kind, p in BASE.items():
        need = f"contains(text, '{NEEDS[kind]}')" if kind in NEEDS else has_digit
        docs = docs.withColumn(f"b_{kind}", F.expr(when_found(kind, p, need)))
    for kind, p in WIDE.items():
        docs = docs.withColumn(f"w_{kind}", F.expr(when_found(kind, p, "contains(text, 'at)') or contains(text, 'at]')" if kind == "email" else has_digit)))
    base = "concat(" + ", ".join(f"filter(b_{k}, x -> {valid(k)})" for k in BASE) + ")"
    docs = docs.withColumn("base", F.expr(base))
    # base spans in chunks by place, so that a wider candidate looks into few of them
    ordered = "array_sort(transform(base, y -> struct(y.start as start, y.end as end)))"
    placed = f"transform({chunks(ordered)}, c -> struct(c[0].start as low, array_max(transform(c, y -> y.end)) as high, c as c))"
    apart = "not exists(placed, p -> p.low < x.end and x.start < p.high and exists(p.c, y -> x.start < y.end and y.start < x.end))"
    seen = "struct(x.kind as kind, x.start as start, x.end as end, x.hit as hit, {wide} as wide, lower(x.before) as before)"
    every = f"concat(transform(concat({', '.join(f'b_{k}' for k in BASE)}), x -> {seen.format(wide='false')}), transform(filter(concat({', '.join(f'w_{k}' for k in WIDE)}), x -> {apart}), x -> {seen.format(wide='true')}))"
    docs = docs.withColumn("every", F.expr(f"transform(array({placed}), placed -> {every})[0]"))  # bound once, not once a candidate
    cols = ", ".join([f"{e} as v_{k}" for k, e in VOTES.items()] + [f"{e} as f_{k}" for k, e in FEATURES.items()])
    tried = F.expr(f"transform(every, x -> struct(x.kind as kind, x.start as start, x.end as end, x.wide as wide, {cols}))")
    return docs.select("doc_id", "own", F.expr("transform(base, x -> struct(x.kind as kind, x.start as start, x.end as end))").alias("base"), tried.alias("tried"))


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Vote pattern -> probability that it is personal data. Votes are independent given the truth, a labeler's
    reliability is how often it votes each way given the truth; starts from labelers that are mostly right."""
    n = len(next(iter(patterns), ()))
    prior, like = 0.5, [{(v, y): 0.6 if v == (1 if y else -1) else 0.2 for v in (-1, 0, 1) for y in (0, 1)} for _ in range(n)]
    total = sum(patterns.values())
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(like[k][v, 1] / like[k][v, 0]) for k, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        yes = sum(post[p] * c for p, c in patterns.items())
        prior = min(0.98, max(0.02, (yes + 1) / (total + 2)))
        for k in range(n):
            for v in (-1, 0, 1):
                for y, mass in ((1, yes), (0, total - yes)):
                    got = sum((post[p] if y else 1 - post[p]) * c for p, c in patterns.items() if p[k] == v)
                    like[k][v, y] = (got + 1) / (mass + 3)
    return post


def classifier(rows: list[Row]) -> tuple[float, dict[str, dict[str, float]]]:
    """Bias and weight of each feature's values (log odds), from rows of votes, features and their counts n."""
    patterns: dict[tuple[int, ...], int] = defaultdict(int)
    for r in rows:
        patterns[tuple(r[f"v_{k}"] for k in VOTES)] += r["n"]
    post = reliabilities(patterns)
    mass, seen = [1.0, 1.0], {f: defaultdict(lambda: [1.0, 1.0]) for f in FEATURES}
    for r in rows:
        p = post[tuple(r[f"v_{k}"] for k in VOTES)]
        for y, w in ((1, p * r["n"]), (0, (1 - p) * r["n"])):
            mass[y] += w
            for f in FEATURES:
                seen[f][r[f"f_{f}"]][y] += w
    # features depend on each other: together they weigh as much as half of them would if they did not
    weights = {f: {v: 0.5 * math.log(w[1] / (mass[1] + len(vs)) / (w[0] / (mass[0] + len(vs)))) for v, w in vs.items()} for f, vs in seen.items()}
    return math.log(mass[1] / mass[0]), weights


def personal_spans(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans of every row of docs(doc_id, text, ...): arrays of (kind, start, end), in order.
    carry: other columns of docs that come along.

    A null text counts as empty and has none. Rows that repeat stay rows. Wider candidates never overlap a base span.
    """
    found = stored(candidates(docs, carry))
    each = found.select(F.explode("tried").alias("x"))
    names = [f"v_{k}" for k in VOTES] + [f"f_{k}" for k in FEATURES]
    # bounded: the number of patterns of votes and features
    rows = each.groupBy(*[F.col(f"x.{n}").alias(n) for n in names]).agg(F.count("*").alias("n")).collect()
    bias, weights = classifier(rows) if rows else (0.0, {})
    score = F.lit(bias)
    out = F.expr("filter(tried, x -> x.wide)")
    tables = {f: F.create_map(*[F.lit(z) for pair in vs.items() for z in pair]) for f, vs in weights.items()}

    def likely(x):
        s = score
        for f, t in tables.items():
            s = s + F.coalesce(F.element_at(t, x[f"f_{f}"]), F.lit(0.0))
        return s >= 0

    added = F.transform(F.filter(out, likely), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    rank = F.create_map(*[F.lit(z) for k, kind in enumerate(ORDER) for z in (kind, k)])

    def ordered(c):
        keyed = F.transform(c, lambda x: F.struct(F.element_at(rank, x["kind"]).alias("r"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return found.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.concat("base", added)).alias("spans"), *[F.col(f"own.{c}").alias(c) for c in carry])


def masked() -> str:
    """SQL: text with [KIND] in place of its spans; where spans overlap, the first takes the place. By chunks of spans, each on
    its own piece of the text."""
    order = "array_sort(transform(spans, x -> struct(x.start as start, x.end as end, x.kind as kind)))"
    ends = "aggregate(cs, array(0), (b, c) -> concat(b, array(greatest(element_at(b, -1), array_max(transform(c, x -> x.end))))))"
    step = """if(x.start < a.at, struct(greatest(a.at, x.end) as at, a.out as out),
        struct(x.end as at, concat(a.out, substr(e.piece, a.at - e.low + 1, x.start - a.at), '[', upper(x.kind), ']') as out))"""
    piece = "struct(b[k] as low, cs[k] as c, substr(text, b[k] + 1, b[k + 1] - b[k]) as piece)"
    each = f"aggregate(e.c, cast(struct(e.low, '') as struct<at:int,out:string>), (a, x) -> {step}, a -> a.out)"
    parts = f"transform(transform(sequence(0, size(cs) - 1), k -> {piece}), e -> {each})"
    whole = f"concat(array_join({parts}, ''), substr(text, element_at(b, -1) + 1))"
    return f"if(size(spans) = 0, text, transform(array({chunks(order)}), cs -> transform(array({ends}), b -> {whole})[0])[0])"


def joined(spans: str):
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of the whole documents table."""
    found = personal_spans(documents(spark, sf_dir, "doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))

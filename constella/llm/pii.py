"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame operations only.

Base spans are leftmost, non-overlapping matches of four kinds. The patterns below match the same spans as the plain ones of
the docstring of ``base_spans`` but are possessive and start only where a match can start, so that time stays linear in the
text.

Bootstrapping: tokens that hold a digit or ``@`` are instances, without the signs around them; their lexical patterns are the
word before, the two words before, the word after, and a label glued to the token by ``:`` or ``=``, each taken whole however
long it is and kept by its MD5. Seeds are the instances inside base spans and those of a shape that only keys have
(``KEYS``). In each round a pattern's support is the number of different seeds and surely scored instances it stands around. Its confidence is a
smoothed ratio of what its scored instances explain against the rest of them and against ordinary numbers; instances not yet
scored are unknown and count on neither side. An instance's score is the chance that at least one of its confident patterns is
right, or the best confidence of the others, and is carried into the next round, so instances found in one round induce
patterns in the next. After the last round the tokens that stand in a confident pattern become spans of kind ``id``, unless
they touch a base span.

All counts are over the whole corpus and combined before the shuffle; the graph's tables are written each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without these has no match of the kind.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "phone": "\\+[0-9]"}
#: Lower-cased shapes of access keys: long hexadecimal digests, and the public prefixes of well-known services.
KEYS = r"^(?:(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}|akia[0-9a-z]{16}|gh[pousr]_[0-9a-z]{36,}|xox[abprs]-[0-9a-z-]{10,}|sk-[0-9a-z_-]{20,}|aiza[0-9a-z_-]{35}|eyj[0-9a-z_-]+\.eyj[0-9a-z_-]+\.[0-9a-z_-]+)$"
TOKEN = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
LEAD, TAIL = r"^[^\p{L}\p{N}@]++", r"[^\p{L}\p{N}@]++$"  # signs around a token, which are no part of the identifier
CONTEXT = ",token:string,before:string,before2:string,after:string"
SPAN = "array<struct<start:int,end:int>>"
BLOCK = 128
ROUNDS, LEAST_SEEDS, CONFIDENT, CARRIED = 3, 5, 0.9, 0.5
#: Lower-cased tokens that are proven to identify nobody unless they are seeds: short numbers, ordinals, decades, times, amounts.
ORDINARY = r"^[^a-z0-9@]*[0-9]{1,4}(?:[.,:/-][0-9]{1,3}){0,2}[a-z]{0,2}[^a-z0-9@]*$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a bound variable, so that ``value`` is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))


def _running(values: Column, kind: str, combine: Callable[[Column, Column], Column]) -> Column:
    """For each integer what ``combine``, which is associative with 0 as its neutral value, makes of those before it.

    Arrays can only be appended to by copying them, so the values are combined in blocks and then inside each block from
    what came before it: a text with very many spans costs little more than its length.
    """
    zero, none = F.lit(0).cast(kind), F.array().cast(f"array<{kind}>")

    def scan(part: Column, at: Column) -> Column:
        step = lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        before = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, combine)), zero)
        return F.flatten(F.zip_with(blocks, before, scan))

    return _let(values, lambda v: _let(_blocks(v), joined))


def _located(text: Column, pattern: str, valid: str, more: str = "", more_type: str = "") -> Column:
    """An array of ``(start, end)`` in code points for the valid matches; ``more`` adds fields from ``m`` and the gaps around it."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    if more:
        pieces = F.zip_with(pieces, F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))), lambda p, r: F.struct(p["g"].alias("g"), p["m"].alias("m"), r.alias("r")))

    def placed(p: Column, at: Column) -> Column:
        begin = at + F.char_length(p["g"])
        return F.struct(begin.alias("start"), (begin + F.char_length(p["m"])).alias("end"), p.alias("p"))

    def spans(ps: Column) -> Column:
        at = _running(F.transform(ps, lambda p: F.char_length(p["g"]) + F.char_length(p["m"])), "int", lambda x, y: x + y)
        good = F.filter(F.zip_with(ps, at, placed), lambda s: _valid(valid, s["p"]["m"]))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *(c.alias(n) for n, c in _fields(more, s["p"]["m"], s["p"]["g"], s["p"]["r"] if more else None))))

    return _let(F.filter(pieces, lambda p: p["m"].isNotNull()), spans).cast(f"array<struct<start:int,end:int{more_type}>>")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = lambda part: F.regexp_replace(part, "^0+", "")
        return F.forall(F.split(m, "\\."), lambda part: F.when(F.char_length(short(part)) > 3, F.lit(False)).otherwise(F.lpad(short(part), 3, "0") <= F.lit("255")))
    if kind == "card":
        return F.when(F.char_length(_digits(m)).between(13, 19), F.call_function("luhn_check", _digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def _fields(more: str, m: Column, g: Column, r: Column | None) -> list[tuple[str, Column]]:
    if more != "context":
        return []
    said = lambda words: F.lower(F.regexp_replace(words, "[ \\t-\\r]++", " "))
    return [
        ("token", F.lower(m)),
        ("before", said(F.regexp_extract(g, r"(?:^|[ \t-\r])([^ \t-\r]++)[ \t-\r]*+$", 1))),
        ("before2", said(F.regexp_extract(g, r"(?:^|[ \t-\r])([^ \t-\r]++[ \t-\r]++[^ \t-\r]++)[ \t-\r]*+$", 1))),
        ("after", said(F.regexp_extract(r, r"^[ \t-\r]*+([^ \t-\r]++)", 1))),
    ]


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind as arrays.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip: four runs of digits joined by dots, each at most 255;
    card ``[0-9]([\\x20-]?[0-9])+`` with 13 to 19 digits passing Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits.
    """
    none = F.array().cast(SPAN)
    return {k: F.when(F.regexp_like(text, F.lit(HINTS[k])), _located(text, PATTERNS[k], k)).otherwise(none) for k in KINDS}


def _marked(tokens: Column, spans: list[Column]) -> Column:
    """Each token ``t`` with ``starting``, a bit for each array of spans one of which starts in it, and ``touched`` by an earlier one."""
    new_token = 1 << len(spans)  # before the first token, and wherever another begins, no span has been met
    entry = lambda s, bit, t: F.struct(s["start"].alias("start"), F.lit(bit).alias("bit"), s["end"].alias("end"), t.alias("t"))

    def merged(ts: Column) -> Column:
        none = F.lit(None).cast(f"struct<start:int,end:int{CONTEXT}>")
        own = F.transform(ts, lambda t: entry(t, 0, t))
        of_kind = lambda s, bit: F.transform(s, lambda x: entry(x, bit, none))
        return F.sort_array(F.concat(own, *[of_kind(s, 1 << i) for i, s in enumerate(spans)]))

    def marks(es: Column) -> Column:
        reach = _running(F.transform(es, lambda e: F.when(e["bit"] > 0, e["end"]).otherwise(F.lit(0))), "int", lambda x, y: F.greatest(x, y))
        after = _running(F.transform(F.reverse(es), lambda e: F.when(e["bit"] > 0, e["bit"]).otherwise(F.lit(new_token))), "int", lambda x, y: F.when(y >= new_token, y).otherwise(x.bitwiseOR(y)))
        both = F.zip_with(reach, F.reverse(after), lambda r, a: F.struct(r.alias("reach"), a.alias("after")))
        out = F.zip_with(es, both, lambda e, b: F.struct(e["bit"].alias("bit"), e["t"].alias("t"), b["after"].bitwiseAND(new_token - 1).alias("starting"), (b["reach"] > e["start"]).alias("touched")))
        return F.filter(out, lambda o: o["bit"] == 0)

    return _let(_let(tokens, merged), marks)


def _spelled(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def find(spark: SparkSession, docs: DataFrame, least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """All columns of ``docs`` plus ``__pii_email, __pii_ip, __pii_card, __pii_phone, __pii_id``: arrays of ``(start, end)`` in code points, end exclusive.

    ``doc_id`` and ``text`` are wanted. Null text: no spans. Null and repeated ids: each row is searched for itself. Empty table: no rows.
    """
    scratch = Scratch(spark)
    extra = [f"__pii_{k}" for k in (*KINDS, "id")]
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({f"__pii_{k}": v for k, v in base_spans(text).items()})
    none = F.array().cast(f"array<struct<start:int,end:int{CONTEXT}>>")
    tokens = F.when(F.regexp_like(text, F.lit("[0-9@]")), _located(text, TOKEN, "", "context", CONTEXT)).otherwise(none)
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text))
    # One row for each instance, with the kind of the base span that starts in it, 'part' if one only touches it.
    marked = _marked(tokens, [F.col(f"__pii_{k}") for k in KINDS])
    tagged = found.where(F.regexp_like(text, F.lit("[0-9@]"))).select(key.alias("row"), F.explode(marked).alias("e")).select("row", "e.t", "e.starting", "e.touched")
    tag = F.coalesce(*[F.when(F.col("starting").bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(KINDS)], F.when(F.col("touched"), F.lit("part")))
    lead = F.char_length(F.regexp_extract("t.token", LEAD, 0))
    core = F.regexp_replace(F.regexp_replace("t.token", LEAD, ""), TAIL, "")
    tagged = tagged.select("row", "t", tag.alias("tag"), (F.col("t.start") + lead).alias("start"), core.alias("core"))
    label = F.regexp_extract("core", "^([^0-9@:=]{2,}[:=])", 1)
    pattern = lambda kind, words: F.when(words != "", F.md5(F.concat(F.lit(f"{kind} "), words)))
    patterns = F.array(pattern(1, F.col("t.before")), pattern(2, F.col("t.before2")), pattern(3, F.col("t.after")), pattern(4, label))
    value = F.regexp_replace("core", "^[^0-9@:=]{2,}[:=][^\\p{L}\\p{N}]*+", "")
    shape = F.when(F.col("tag").isNull() & F.regexp_like(value, F.lit(KEYS)), F.lit("key"))
    tagged = tagged.select("row", "start", (F.col("start") + F.char_length("core")).alias("end"), F.coalesce("tag", shape).alias("tag"), F.md5("core").alias("instance"), F.regexp_like("core", F.lit(ORDINARY)).alias("ordinary"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))
    tagged = scratch.save(tagged)
    edges = tagged.where("tag is null or tag <> 'part'").select(F.explode("patterns").alias("pattern"), "instance", "ordinary", "tag").groupBy("pattern", "instance", "ordinary").agg(F.count("*").alias("n"), F.count("tag").alias("seeds"))
    edges = scratch.save(edges)
    known = scratch.save(edges.where("seeds > 0").select("instance").distinct().withColumn("score", F.lit(1.0)))
    scores, spent = known, []
    score = F.coalesce("score", F.when(F.col("ordinary"), F.lit(0.0)))  # null: unknown
    right, wrong = F.coalesce(F.sum(F.col("n") * score), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * (1 - score)), F.lit(0.0))
    for turn in range(ROUNDS):
        # All patterns take part in each round: what was found in one round supports patterns without any seed in the next.
        rated = edges.join(scores, "instance", "left").groupBy("pattern").agg(F.count_if(score >= confident).alias("support"), F.round((right + 0.5) / (right + wrong + 1), 9).alias("confidence"))
        rated = scratch.save(rated.where((F.col("support") >= least_seeds) & (F.col("confidence") >= min(CARRIED, confident))).select("pattern", "confidence"))
        spent += [rated, scores]
        if turn < ROUNDS - 1:
            doubt = F.when(F.col("confidence") >= confident, F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))).otherwise(0.0)
            unseen = edges.where("not ordinary").join(rated, "pattern").groupBy("instance").agg(F.round(F.greatest(F.max("confidence"), 1 - F.exp(F.sum(doubt))), 9).alias("score"))
            scores = scratch.save(known.union(unseen.join(known, "instance", "left_anti")))
    good = rated.where(F.col("confidence") >= confident)
    new = tagged.where("tag is null or tag = 'key'").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    new = new.join(good, "pattern", "left_semi").groupBy(F.col("row").alias("__pii_of")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__pii_id"))
    new = scratch.save(new)
    scratch.drop(tagged, edges, known, *spent)
    out = found.withColumn("__pii_row", key).join(new, F.col("__pii_row") == F.col("__pii_of"), "left").withColumn("__pii_id", F.coalesce("__pii_id", F.array().cast(SPAN)))
    return out.select(*[docs[c] for c in docs.columns], *extra)


def digest(found: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, the digest of the base spans, all spans spelled out, and ``n_id``."""
    base = F.concat(*[_spelled(F.col(f"__pii_{k}"), k) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(f"__pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _spelled(F.col("__pii_id"), "id")), ",").alias("spans"),
        F.size("__pii_id").cast("long").alias("n_id"),
    )


def masked(found: DataFrame) -> DataFrame:
    """The columns of the documents, each span of the text replaced by its kind in angle brackets; touching spans become one."""
    kinds = (*KINDS, "id")

    def labelled(kind: str) -> Column:
        return F.transform(f"__pii_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind}>").alias("mask")))

    all_spans = F.sort_array(F.concat(*[labelled(k) for k in kinds]))

    def cut(block: Column) -> Column:
        """The text before each span of a block and its mask; positions are looked up in the block's own stretch of text."""
        first = F.get(block, F.lit(0))["at"]
        stretch = F.substring("text", first + 1, F.element_at(block, -1)["s"]["start"] - first)
        return _let(stretch, lambda x: F.array_join(F.transform(block, lambda c: F.concat(F.substring(x, c["at"] - first + 1, c["s"]["start"] - c["at"]), c["s"]["mask"])), ""))

    def replaced(spans: Column) -> Column:
        at = _running(F.transform(spans, lambda s: s["end"]), "int", lambda x, y: F.greatest(x, y))
        kept = F.filter(F.zip_with(spans, at, lambda s, a: F.struct(s.alias("s"), a.alias("at"))), lambda c: c["s"]["start"] >= c["at"])
        rest = F.substring("text", F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.char_length("text"))
        return F.concat(F.array_join(_let(kept, lambda k: F.transform(_blocks(k), cut)), ""), rest)

    done = _let(all_spans, replaced)
    text = F.when(F.size(all_spans) > 0, done).otherwise(F.col("text"))
    return found.withColumn("text", text).drop(*[f"__pii_{k}" for k in kinds])

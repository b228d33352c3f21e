"""Licences, personal data, contamination, sharding, tokens against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from constella.llm import contain, licences, pii, sharding, tokens
from constella.llm.queries import ORACLE_SQL, QUERIES, TOKENIZERS

BPE = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.mark.parametrize("name", ["op6_decontamination", "op7_sharding"])
def test_query_equals_its_sql(spark, small, oracle, answer, name):
    assert answer(QUERIES[name](spark, small)) == oracle(ORACLE_SQL[name])


def units(text):
    return set(re.split("\r?\n", text)) | {p for p in re.split("\r?\n[ \t]*\r?\n\\s*", text) if "\n" in p} | {text}


def licence_hits(rows):
    known, out = [(n, licences.bigrams(t)) for n, t in licences.TEMPLATES], collections.Counter()
    for i, text in rows:
        for u in units(text or ""):
            a = licences.bigrams(u)
            out.update((i, n) for n in {n for n, b in known if a and 200 * len(a & b) >= 80 * (len(a) + len(b))})
    return out


def test_licences(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(9001, f"x\n\n{licences.MIT_TEXT}\n\ny"), (9002, licences.GPL_NOTICE.replace("hope", "trust")), (9003, None), (9004, ""), (9005, "a " * 3000), (9006, "released UNDER the mit license"), (9007, "released under the m\u0130t license"), (9008, "wor\u212a released under the mit license")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.licence): r.units for r in got.collect()} == licence_hits(rows)
    assert licence_hits(rows)[9001, "MIT"] and licence_hits(rows)[9002, "GPL-3.0"]
    assert licences.scan(docs.limit(0)).collect() == []


def test_licences_of_several_paragraphs_and_inside_prose(spark):
    parted = {n: re.sub(r"(\.|:) (?=[A-Z])", r"\1\n\n", t) for n, t in (("MIT", licences.MIT_TEXT), ("BSD-2-Clause", licences.BSD_TEXT), ("Apache-2.0", licences.APACHE_NOTICE), ("GPL-3.0", licences.GPL_NOTICE))}
    prose = " ".join(f"word{i} of the" for i in range(150))
    rows = [(i, f"{prose}\n\n{t}\n\n{prose}") for i, t in enumerate(parted.values())] + [(10, "This tool is free to use. Released under the MIT License. See the docs."), (11, f"{prose}\n\n{licences.MIT_TEXT[:300]}\n\n{prose}"), (12, "the MIT license is under discussion, released or not")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.licence, r.units) for r in got if r.doc_id < 4} == {(i, n, 1) for i, n in enumerate(parted)}
    assert [(r.licence, r.units, r.best_dice) for r in got if r.doc_id >= 10] == [("MIT", 1, 1.0)]
    assert min(r.best_dice for r in got) > 0.95


def luhn(s):
    return sum((int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10))) for i, c in enumerate(reversed(s))) % 10 == 0


def base(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x if "@" in x else "")]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x if "." in x else "") if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m)) <= 15]


def test_base_spans(spark, small):
    rng = random.Random(3)
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    for k in range(1500):
        letters = rng.choice(["a.@b-", "1.2", "1 -2", "+1 (.)-", "ab@. 1-+é", "4 -", "😀1.@a"])
        rows.append((10_000 + k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))))
    rows += [(50_000, "a" * 100_000), (50_001, "1" * 100_000), (50_002, "a@b.c_d@e.f " * 500), (50_003, None), (50_004, "1.2.3.4.5.6.7.8 x +1" + " " * 50_000), (50_005, "a." * 40_000), (50_006, "x@" + "a." * 40_000 + "b"), (50_007, " ".join(f"w{i} me{i}@x.org 10.0.{i % 300}.1 é" for i in range(4000)))]
    got = pii.digest(pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        b = base(texts[r.doc_id] or "")
        spelled = [f"{k}:{s}:{e}" for k, s, e in b]
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest(), r
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in b) for k in pii.KINDS]
        assert set(spelled) <= set(r.spans.split(",")) | ({""} if not spelled else set())


def test_masks_of_many_spans(spark):
    rows = [(1, " ".join(f"é{i} me{i}@x.org 10.0.0.{i % 256}, +1 415 555 {i:04d}" for i in range(700))), (2, "a@b.cc"), (3, "none"), (4, None), (5, "x +1.2.3.4.5.6.7.8.9 y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.masked(pii.find(spark, docs)).collect():
        text, at, want = dict(rows)[r.doc_id], 0, []
        for start, end, kind in sorted((s, e, k) for k, s, e in base(text or "")):
            if start >= at:
                want += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        assert r.text == (text if text is None else "".join(want) + text[at:])


def test_tokens_are_marked_by_the_spans_that_start_in_or_touch_them(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = []
    for i in range(300):
        cuts = sorted(rng.sample(range(400), 2 * rng.randint(0, 90)))
        spans = [sorted(rng.sample(range(400), 2 * rng.randint(0, 12))) for _ in pii.KINDS]
        rows.append((i, *[[(a, b) for a, b in zip(c[::2], c[1::2], strict=True)] for c in (cuts, *spans)]))
    whole = f"array<struct<start:int,end:int{pii.CONTEXT}>>"
    df = spark.createDataFrame(rows, f"i int, t {pii.SPAN}, " + ", ".join(f"{k} {pii.SPAN}" for k in pii.KINDS))
    tokens = F.transform("t", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), *[F.lit("").alias(c) for c in ("token", "before", "before2", "after")])).cast(whole)
    for r in df.select("*", pii._marked(tokens, [F.col(k) for k in pii.KINDS]).alias("m")).collect():
        nexts = [*[t.start for t in r.t[1:]], 10**9][: len(r.t)]
        for t, after, m in zip(r.t, nexts, r.m, strict=True):
            assert (m.t.start, m.t.end) == (t.start, t.end)
            assert m.starting == sum(1 << j for j, k in enumerate(pii.KINDS) if any(t.start <= s.start < after for s in r[k]))
            assert m.touched == any(s.start < t.start < s.end for k in pii.KINDS for s in r[k])


def test_context_finds_unseen_identifiers_and_leaves_others(spark):
    rows = [(i, f"please write to contact me{i}@mail.example today") for i in range(20)] + [(100, "please write to contact user77123-x today"), (101, "the year 19950 was long and 20011 too"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    found = {r.doc_id: r for r in pii.digest(pii.find(spark, docs)).collect()}
    assert found[100].n_id == 1 and found[100].spans.startswith("id:24:")
    assert found[101].n_id == 0 and found[102].spans == ""
    masked = {r.doc_id: r for r in pii.masked(pii.find(spark, docs)).collect()}
    assert masked[3].text == "please write to contact <email> today" and masked[100].text == "please write to contact <id> today"
    assert masked[101].text == rows[21][1] and masked[102].text is None and masked[3].row == "clash"


def test_found_identifiers_induce_patterns_without_base_seeds(spark):
    rows = [(i, f"please write to contact me{i}@mail.example today") for i in range(200)] + [(1000 + i, f"please write to contact user77{i:03d}-x today") for i in range(12)]
    rows += [(2000 + i, f"show badge no user77{i:03d}-x there") for i in range(12)] + [(3000, "wear badge no zx99812"), (3001, "room about zx99813")]
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[3000] == "id:14:21" and found[2003].startswith("id:14:") and found[3001] == ""


def test_unseen_identifiers_do_not_count_against_their_pattern(spark):
    for many in (3, 20):
        rows = [(i, f"please write to contact me{i}@mail.example today") for i in range(20)] + [(100 + i, f"please write to contact user7712{i}-x today") for i in range(many)] + [(200, "please write to contact bo4 today")]
        rows += [(300 + i, f"open since me{i}@mail.example") for i in range(20)] + [(400 + i, f"open since {1950 + i}") for i in range(20)] + [(500, "open since zx99812")]
        found = {r.doc_id: r for r in pii.digest(pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
        assert all(found[i].n_id == 1 for i in [*range(100, 100 + many), 200])
        assert all(found[i].n_id == 0 for i in [*range(400, 420), 500])


def brute_bootstrap(rows, rounds=pii.ROUNDS, least=pii.LEAST_SEEDS, confident=pii.CONFIDENT):
    """The whole bootstrapping in plain Python: the spans of kind id of each row."""
    tokens = []
    for n, (_, text) in enumerate(rows):
        text = text or ""
        spans = [(s, e) for _, s, e in base(text)]
        words = list(re.finditer(r"[^ \t-\r]+", text))
        places = [m for m in words if re.search("[0-9@]", m[0])]
        for at, m in enumerate(words):
            if not re.search("[0-9@]", m[0]):
                continue
            after = next((x.start() for x in places if x.start() > m.start()), 10**9)
            starting, touched = any(m.start() <= s < after for s, _ in spans), any(s < m.start() < e for s, e in spans)
            lead = len(re.match(r"[^\w@]*", m[0].replace("_", "-"))[0])
            core = m[0].lower()[lead:]
            core = core[: len(core) - len(re.search(r"[^\w@]*$", core.replace("_", "-"))[0])]
            # words without a digit or sign before it, up to the last instance, and after it, up to the next
            plain = []
            for w in reversed(words[:at]):
                if w in places:
                    break
                plain.append(w[0].lower())
            follow = words[at + 1][0].lower() if at + 1 < len(words) and words[at + 1] not in places else None
            label = re.match("[^0-9@:=]{2,}[:=]", core)
            pats = [*([(1, plain[0])] if plain else []), *([(2, plain[1], plain[0])] if len(plain) > 1 else []), *([(3, follow)] if follow else []), *([(4, label[0])] if label else [])]
            value = re.sub(r"^[^0-9@:=]{2,}[:=][^\w]*", "", core)
            tag = "base" if starting else "part" if touched else "key" if re.search(pii.KEYS, value) else None
            tokens.append((n, m.start() + lead, m.start() + lead + len(core), tag, core, bool(re.search(pii.ORDINARY, core)), pats))
    known = {t[4] for t in tokens if t[3] in ("base", "key") and t[6]}
    scores = dict.fromkeys(known, 1.0)
    for _ in range(rounds):
        of = collections.defaultdict(collections.Counter)
        plain = {t[4]: t[5] for t in tokens}
        for t in tokens:
            if t[3] != "part":
                for p in t[6]:
                    of[p][t[4]] += 1
        value = lambda c: scores.get(c, 0.0 if plain[c] else None)
        rated = {}
        for p, cs in of.items():
            right, wrong = (sum(k * f(value(c)) for c, k in cs.items() if value(c) is not None) for f in (lambda v: v, lambda v: 1 - v))
            if sum((value(c) or 0) >= confident for c in cs) >= least and (conf := (right + 0.5) / (right + wrong + 1)) >= pii.CARRIED:
                rated[p] = conf
        fresh = {}
        for c in {t[4] for t in tokens if not t[5] and t[3] != "part"} - known:
            mine = [rated[p] for p in of if c in of[p] and p in rated]
            if mine:
                miss = 1.0
                for r in mine:
                    miss *= max(1 - r, 1e-9) if r >= confident else 1
                fresh[c] = max(max(mine), 1 - miss)
        last, scores = rated, dict.fromkeys(known, 1.0) | fresh
    out = collections.defaultdict(set)
    for n, s, e, tag, _, _, pats in tokens:
        if tag in (None, "key") and any(last.get(p, 0) >= confident for p in pats):
            out[n].add((s, e))
    return {n: ",".join(f"id:{s}:{e}" for s, e in sorted(v)) for n, v in out.items()}


def test_bootstrapping_equals_plain_python(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    long = "x" * 200
    for i in range(40):
        rows.append((20_000 + i, rng.choice(["we {0} by token = \"{1}\"### here", "Contact\n me{2}@mail.example, or", "the year {3} was", "{4} {1} said", "id=k{2}z;", "id=q{2}z or +1 415 555 {3}", "secret: {1}!"]).format(rng.choice("abc"), key(), i, 1900 + i, long)))
    rows += [(21_000, "token = \"no9-key\", and"), (21_001, f"{long} zz9-9zz"), (21_002, None), (None, "token = q1w2e3r4")]
    rows += [(22_000 + i, f"{long} {key()} x") for i in range(6)] + [(20_000, rows[-1][1])]
    got = collections.Counter((r.doc_id, ",".join(s for s in r.spans.split(",") if s.startswith("id:"))) for r in pii.digest(pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    want = brute_bootstrap(rows)
    assert got == collections.Counter((i, want.get(n, "")) for n, (i, _) in enumerate(rows))
    assert any(i == 21_001 and s for i, s in got) and any(i == 21_000 and s for i, s in got)


def test_keys_behind_a_label_are_found_and_masked(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: r for r in pii.masked(pii.find(spark, docs)).collect()}
    rows = docs.collect()
    held = [r for r in rows if re.search('token = "[0-9a-f]{40}"', r.text or "")]
    assert held and all(not re.search("token = .?[0-9a-f]{40}", found[r.doc_id].text) for r in held)
    clean = [r for r in rows if not base(r.text or "") and not re.search("token = ", r.text or "", re.I)]
    assert all(found[r.doc_id].text == r.text for r in clean)


def test_pii_of_an_empty_table(spark):
    assert pii.digest(pii.find(spark, spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_containment(spark):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[:30])
    docs = [(1, " ".join([f"a{i}" for i in range(30_000)]) + " " + item.upper()), (2, " ".join(words[3:30])), (3, " ".join(words[8:30])), (4, None), (5, ""), (6, "w0 w1 w2"), (None, item), (7, item), (7, item)]
    items = [(1, item), (2, None), (3, "too short"), (4, " ".join(words[100:105]))]
    got = contain.contained(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 26, 26), (2, 1, 23, 26), (7, 1, 26, 26)]
    assert contain.least_draws(80) < 24 * 0.8
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contain.contained(spark, spark.createDataFrame(docs, "doc_id long, text string"), empty).collect() == []


def test_containment_of_short_items(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(1, "so What IS two plus two"), (2, "what is\ttwo  plus"), (3, "what is two minus"), (4, "plus"), (5, " ".join(words)), (6, "two plus what is"), (7, None), (8, ""), (9, "plus " * 3000)]
    items = [(1, "what is two plus"), (2, "Plus"), (3, "is two"), (4, ""), (5, None), (6, " ".join(words[3:20])), (None, "plus"), (7, " ".join(words[3:10]))]

    def runs(text, n):
        w = (text or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = []
    for i, t in items:
        n = min(5, len((t or "").split()))
        if i is not None and n:
            own = runs(t, n)
            want += [(d, i, len(own & runs(x, n)), len(own)) for d, x in docs if 100 * len(own & runs(x, n)) >= 80 * len(own)]
    frames = [spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS length"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS all")]
    assert sorted(map(tuple, contain.contained(spark, *frames).collect())) == sorted(want)
    assert contain.contained(spark, frames[0].limit(0), frames[1]).collect() == []
    assert contain.class_share(0, 80) == 100 and contain.class_share(3, 80) == 80


def test_sharding_spreads_small_sources_and_equal_rows(spark):
    rows = [(i, "t", "hot") for i in range(2000)] + [(10_000 + i, "t", f"one{i}") for i in range(2000)] + [(7, "same", "copies")] * 900 + [(None, f"x{i}", "none") for i in range(400)]
    got = sharding.interleave(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    per = collections.Counter((r.stratum[:3], r.shard) for r in got)
    sizes = collections.Counter(r[2][:3] for r in rows)
    for (stratum, _), n in per.items():
        assert abs(n - sizes[stratum] / 8) <= (75 if stratum == "one" else 40), per  # single rows fall at random: six deviations
    assert len(per) == 8 * 4


def test_sharding_law_and_mixture(spark):
    rows = [(i, "t" * (i % 7), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(2003)] + [(None, None, None), (5, "same", "hot"), (5, "same", "hot")]
    got = sharding.interleave(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("place", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))).collect()
    assert len(got) == len(rows)
    by = collections.Counter(r.shard for r in got)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    mixture = collections.Counter((r.stratum, r.shard) for r in got)
    # the first rows up to a fractional rank are that share of the whole, give or take half a row a stratum
    sizes = collections.Counter(r.stratum for r in got)
    for (stratum, _), n in mixture.items():
        assert abs(n - sizes[stratum] / 8) <= 1 + len(sizes) * sizes[stratum] / len(rows) + 1
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)}
    assert all(r.text_crc32 == zlib.crc32(b"same") for r in got if r.size == 5 and r.doc_id == 5)
    assert sharding.interleave(spark, spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_chunks_splice_to_the_same_tokens():
    t, rng = tokens.load(BPE), random.Random(1)
    for _ in range(300):
        letters = rng.choice(["ab \n", "a", "  \n\n\t ", "é漢🙂 x", "0 1,.", "don't 'll"])
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400)))
        if rng.random() < 0.5:
            x = x.replace("a", "<|endoftext|>")
        assert tokens.chunked_ids(t, x, rng.randint(1, 60), rng.randint(1, 30)) == t.encode(x, add_special_tokens=False).ids


def test_token_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(9001, None), (9002, ""), (None, "x <|endoftext|> y"), (9003, "long words and 123 numbers\n" * 8000), (9004, "a" * 60_000)]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect()
    t = tokens.load(BPE)
    want = collections.Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in rows)
    assert collections.Counter(map(tuple, got)) == want

"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common as C
from lodestone.llm import components, decontaminate, jaccard_join, line_dedup, packing, pii, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PARTS = ["an", "er", "tion", "le", "ché", "os", "un", "ment", "re", "ou", "über", "la"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, upper=False):
    out = []
    while len(out) < n:
        out.append(" ".join("".join(rng.choices(PARTS, k=rng.randint(1, 3))) for _ in range(min(n - len(out), rng.randint(4, 14)))).split())
        out = [w for x in out for w in ([x] if isinstance(x, str) else x)]
    lines, i = [], 0
    while i < len(out):
        k = rng.randint(5, 30)
        lines.append(" ".join(out[i : i + k]) + ".")
        i += k
    return "\n".join(lines)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 12, 60, 200, 400])) for _ in range(n)]
    texts += [None, "", " ", "\n\n", "one two", "one two", "\t\x0b x \x0c", "ünï 日本 🙂"]
    texts += [texts[i] for i in (2, 3, 3, 5)]  # copies
    for i in (4, 5, 6, 7, 8, 9):  # near copies
        words = texts[i].split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    passage = prose(rng, 120)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 30) for _ in range(6)]
    texts += ["ab" * 700, "a" * 1000, prose(rng, 4000)]
    rng.shuffle(texts)
    return texts


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, ["en", "fr", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    # columns that operators use themselves must not clash
    return spark.createDataFrame(rows, SCHEMA).withColumns({"name": F.lit("x"), "key": F.lit(1), "score": F.lit(0.5), "component": F.lit(7)}).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1


def repeated(texts, w):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + w] for b in data for i in range(len(b) - w + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - w + 1):
            if count[b[i : i + w]] > 1:
                cover[i] += 1
                cover[i + w] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [2000, 2])
def test_repeats(docs, texts, most):
    """With ``most`` = 2 nearly every group is dealt anew, down to single windows."""
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs, most).collect()}
    assert got == dict(enumerate(repeated(texts, 400)))


def test_repeats_of_nothing(empty):
    assert suffix_dedup.dedup(empty).count() == 0


def test_run_index():
    rng = np.random.default_rng(0)
    for _ in range(200):
        strings = list({bytes(rng.integers(97, 99, rng.integers(3, 50)).astype(np.uint8).tolist()) for _ in range(6)})
        count = collections.Counter(s[i : i + 6] for s in strings for i in range(len(s) - 5))
        for s, flags in zip(strings, suffix_dedup.repeated_starts(strings, 6), strict=True):
            assert flags.tolist() == [count[s[i : i + 6]] > 1 for i in range(max(0, len(s) - 5))]
    text = np.frombuffer(b"abracadabra" * 50 + b"\xff", np.uint8)
    assert len(suffix_dedup.RunIndex(text, [len(text) - 1]).run_byte) < 20  # runs, not bytes


# 2 and 6


def test_toxicity(spark, empty):
    rng = random.Random(1)
    texts, y = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = prose(rng, rng.choice([20, 80, 300]))
        if bad:
            t += " " + rng.choice(["vilkan", "vilkur", "grumsel"]) + " " + rng.choice(["vilkan", "grumset"])
        if i % 5 == 0 or bad and rng.random() < 0.7:
            t += " women"
        texts.append(t)
        y.append(int(bad))
    df = frame(spark, [*texts, None, ""])
    got = toxicity.score(df, labels(spark, [(i, None, v) for i, v in enumerate(y)] + [(0, None, y[0]), (None, 1, 1)])).collect()
    assert len(got) == 402 and {r["predicted"] for r in got} == {0, 1}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == y[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.keep_clean(df, labels(spark, [(i, None, v) for i, v in enumerate(y)]))
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"] == 0}
    assert toxicity.score(empty, labels(spark, [])).count() == 0
    assert toxicity.score(frame(spark, ["a b"]), labels(spark, [])).first()["score"] == 0.5


def test_counterfactuals_keep_mentions_neutral():
    rng = random.Random(2)
    rows, y = [], []
    for i in range(300):
        bad = i % 3 == 0
        t = prose(rng, 30) + (" vilkan grumsel" if bad and rng.random() < 0.8 else "")
        if bad or rng.random() < 0.05:
            t += " women"
        rows.append(toxicity._of(t))
        y.append(float(bad))
    mention, other = toxicity._of("women here"), toxicity._of("men here")

    def gap(swap):
        m = toxicity.fit(rows, np.asarray(y), swap=swap)
        weight = dict(zip(m.index.tolist(), m.weight.tolist(), strict=True))
        return abs(sum(weight.get(f, 0) for f in mention.tolist()) - sum(weight.get(f, 0) for f in other.tolist()))

    assert gap(5.0) < 0.5 * gap(0.0)


def test_quality(spark, empty):
    rng = random.Random(4)
    texts, y = [], []
    for i in range(300):
        t = prose(rng, rng.choice([20, 80, 200]))
        if i % 4 == 0:
            t = rng.choice([t.upper(), " | ".join(t.split()), " ".join(w + "%%%" for w in t.split())])
        texts.append(t)
        y.append(int(i % 4 != 0))
    got = quality_classifier.score(frame(spark, [*texts, None, ""]), labels(spark, [(i, v, 0) for i, v in enumerate(y)])).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["predicted"] == y[r["doc_id"]] for r in held) >= 0.95 * len(held) and len(got) == 302
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert quality_classifier.score(empty, labels(spark, [])).count() == 0


def test_quality_trains_on_whole_texts(spark, monkeypatch):
    rng, seen = random.Random(23), []
    texts = [prose(rng, n) for n in (5, 400, 3_000)] + [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(2_000)), ""]
    monkeypatch.setattr(quality_classifier, "fit", lambda rows, y: seen.extend(rows[i] for i in range(len(rows))) or quality_classifier.Model(np.empty(0), 0.0))
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    quality_classifier.score(frame(spark, texts, ids=ids), labels(spark, [(i, 1, 0) for i in ids]))
    assert len(seen) == len(texts)
    for t, (buckets, counts) in zip(texts, seen, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        want = collections.Counter(quality_classifier.features(np.asarray([0, len(raw)]), raw)[0].tolist())
        assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == want


def test_quality_features_stay_in_rows():
    raw = np.frombuffer(b"abcabc xyz", np.uint8)
    whole, _ = quality_classifier.features(np.asarray([0, 3, 6, 10]), raw)
    parts = [quality_classifier.features(np.asarray([0, len(p)]), np.frombuffer(p, np.uint8))[0] for p in (b"abc", b"abc", b" xyz")]
    assert sorted(whole.tolist()) == sorted(x for p in parts for x in p.tolist())


# 3


def test_packing(spark, docs, texts, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for capacity in (64, 2048):
        rows = packing.pack(docs, path, capacity).collect()
        want, seen = [], collections.defaultdict(list)
        for i, t in enumerate(texts):
            ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
        for r in rows:
            seen[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in seen.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(r["length"] for r in rows)
        assert len(seen) <= -(-total // capacity) * 11 // 9 + 1
    assert packing.pack(empty, path).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    sizes = sorted((rng.randint(1, 50) for _ in range(400)), reverse=True)
    rows, opened = packing.plan(collections.Counter(sizes), 50)
    gaps = []
    for s in sizes:
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(50 - s)
    assert opened == len(gaps)


def test_encoder_equals_tokenizer():
    P = pytest.importorskip("public_tokenizers")
    e = packing.Encoder(P.path("word_bpe_49k.json"))
    for t in ["It's we're <|endoftext|> x<|endoftext|>y", "ﬁ ÀÉ ǅ Σας ΣΑΣ á b ́c", "日本 123 4.5", "a\tb c d \x1c e", "!!! ...' 's", "İstanbul ß ſ", " ", "", "x\n\ny"]:
        assert e.encode(t) == np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()

def test_encoder_needs_the_whole_tokenizer_for_other_characters_only():
    """Digits, contractions, quotes and controls of Latin-1 are encoded without it, as it would."""
    P = pytest.importorskip("public_tokenizers")
    e, rng = packing.Encoder(P.path("word_bpe_49k.json")), random.Random(5)
    characters = [*map(chr, range(256)), *([*"abcstdmlreDV''''  \n.,0123", "'LL", "<|"] * 2)]
    texts = ["Don't say \"we'LL\" at 12:30, l'été ½ µ\xa0x\x85y", *("".join(rng.choices(characters, k=30)) for _ in range(3000))]
    mixed = [t + rng.choice(["İ", "K", "é", "中", "<|endoftext|>"]) + t[::-1] for t in texts[:500]]
    want = {t: np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts + mixed}
    assert all(e.encode(t) == want[t] for t in mixed)
    e.tokenizer = None
    assert all(e.encode(t) == want[t] for t in texts)


# 4


def shingles(t, k, strip=""):
    ws = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w.strip(strip)) for w in WORD.findall(t or "")]
    ws = [w for w in ws if w]
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) or (frozenset([tuple(ws)]) if ws else frozenset())


def test_decontamination(spark, empty):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (3, 8, 11, 20, 40, 60, 200)] + ["", None]
    texts = [prose(rng, n) for n in (5, 50, 500, 3000)]
    texts += [prose(rng, rng.choice([10, 400])) + " " + (items[i % 7]) + "\n" + prose(rng, 50) for i in range(14)]
    texts += [prose(rng, 30) + " " + " ".join(items[5].split(" ")[:40]) + " " + prose(rng, 30), None, "", items[0], items[4].upper()]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    marks = ".,;:!?\"'()[]{}|*#$%&<>"
    want = {}
    for i, t in enumerate(texts):
        own = shingles(t, 5, marks)
        want[i] = [j for j, x in enumerate(items) if (q := shingles(x, 5, marks)) and len(q & own) >= 0.8 * len(q)]
    for most in (4_000_000, 300):  # the latter in several blocks of items
        got = {r["doc_id"]: sorted(r["item_ids"]) for r in decontaminate.find(frame(spark, texts), bench, most_broadcast=most).collect()}
        assert got == want
    assert decontaminate.find(empty, bench).count() == 0
    assert not decontaminate.find(frame(spark, ["a b c"]), bench.limit(0)).first()["contaminated"]


# 5

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_pii(spark, empty):
    rng = random.Random(7)
    bits = ["a.b@c.example.com", "x@y", "@", "a@b@c.de", "..@a.b", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "477743168656", "+1 (988) 555-2485", "+1", "+49 30 1234567", "é", "日本", "0000000000000000", "ü@x.yz", "(988) 555-2485", "12:30", "2024-05-01", "..", "+", "-"]
    texts = ["".join(rng.choice([b, b + " ", b + "\n", " wörd "]) for b in rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)]
    texts += [None, "", "1" * 50_000, "a" * 50_000 + "@", "+" + "1(" * 20_000, "1.1.1." * 5000]
    for r in pii.find(frame(spark, texts)).collect():
        spans = brute_spans(texts[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[3] == k for s in spans) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        got = r["spans"].split(",") if r["spans"] else []
        assert set(base.split(",") if base else []) <= set(got)
        places = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in got if s not in base.split(","))
        assert all(a < b for a, b in places)
    assert pii.find(empty).count() == 0


def test_field_on_other_fillings():
    field, wrong, total = pii.train(), 0, 0
    for tokens, tags in pii.labelled_table(copies=3, seed=99):
        path = field.decode([np.stack([field.scores(tokens, i) for i in range(len(tokens))])])[0].tolist()
        wrong += path != tags
        total += 1
    assert wrong <= 0.03 * total


def test_field_adds_what_patterns_miss(spark):
    r = pii.find(frame(spark, ["please call (988) 555-2485 today", "in 1999 we had 477743168656 of them"])).orderBy("doc_id").collect()
    assert "phone" in r[0]["spans"] and r[1]["spans"] == ""


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    field = pii.Field({}, np.zeros((0, 3)), rng.normal(size=(3, 3)))
    import itertools

    for n in (1, 2, 5):
        x = rng.normal(size=(n, 3))

        def total(p):
            return sum(x[t, y] for t, y in enumerate(p)) + sum(field.step[a, b] for a, b in zip((0, *p), (*p, 0), strict=True))

        assert tuple(field.decode([x])[0]) == max(itertools.product(range(3), repeat=n), key=total)


# 7


def test_rules(spark, docs, texts, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels(spark, [(i, 1, 0) for i in range(len(texts))])).collect()}
    for i, t in enumerate(texts):
        ws, seen, dup = WORD.findall(t or ""), set(), 0
        windows = collections.defaultdict(list)
        for j in range(len(ws) - 4):
            windows[tuple(ws[j : j + 5])].append(j)
        cover = {j + d for v in windows.values() if len(v) > 1 for j in v for d in range(5)}
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(ws) < 10 or 100 * len(cover) > 20 * len(ws)) and got[i]["kept"] == (not got[i]["base_failed"])
    assert quality_rules.judge(empty, labels(spark, [])).count() == 0


def test_binomial():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 50, 0.05), (40, 400, 0.1), (7, 7, 0.3)):
        assert quality_rules.binomial_at_most(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_limit_false_rejections():
    """The rules' steps together, not each by itself, keep to the risk; a stratum needs 144 good documents where there are four."""
    risk, level = 0.03, 0.05 / 4
    assert quality_rules.steps_taken(0, [0, 0], risk, level) == 0
    assert quality_rules.steps_taken(143, [0, 0], risk, level) == 0 and quality_rules.steps_taken(144, [0, 0], risk, level) == 2
    assert quality_rules.steps_taken(5000, [0, 20, 400, 400], risk, level) == 2
    rng, bad = np.random.default_rng(0), 0
    rates = np.linspace(0, 0.09, 14)  # true rates of false rejection by all steps so far
    for _ in range(400):
        first = np.searchsorted(rates, rng.random(3000))  # a document's first step that rejects it
        taken = quality_rules.steps_taken(3000, [int((first <= t).sum()) for t in range(14)], risk, 0.05)
        assert taken >= 2
        bad += rates[taken - 1] > risk
    assert bad <= 30


def test_path_takes_the_best_steps_first():
    counts = {"x": [(0, 0), (2, 40), (90, 41)], "y": [(1, 9), (1, 9), (1, 30)], "z": [(5, 5), (5, 5)]}
    # x up to its second cutoff, 3 / 41, is worse than y up to its last, 2 / 31; the rest adds no more bad than good documents
    assert quality_rules.learned_path(counts) == [("y", 0), ("y", 1), ("y", 2), ("x", 0), ("x", 1)]
    assert quality_rules.learned_path({"x": [(0, 4)], "y": [(0, 4)]}) == [("x", 0), ("y", 0)]
    assert quality_rules.learned_path({"x": [(0, 0), (3, 0)]}) == []


def test_verdict_by_brute_force(spark):
    """Cutoffs and verdicts recomputed in plain Python over the measures, for two languages with enough labels and one without."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        good = rng.random() < 0.7
        body = prose(rng, rng.randint(12, 40))
        if not good:
            body += rng.choice([" ##$ %%", " !!! ??", " AAAA BBBB CCCC"]) * rng.randint(1, 12)
        elif rng.random() < 0.01:
            body += " #" * 30
        lang = ["en", None, "fr"][0 if i % 2 else 1 if i % 20 else 2]
        rows.append((i, body, lang, "s", len(body), int(good) if rng.random() < 0.95 else None))
    docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    given = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, quality int")
    got = quality_rules.judge(docs, given).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2))).collect()
    assert len(got) == len(rows)
    ladders = {rule: (expr.replace("greatest", "max"), cuts) for rule, (expr, cuts) in quality_rules.LADDERS.items()}
    value = {r["doc_id"]: {rule: eval(expr, {"max": max}, r.asDict()) for rule, (expr, _) in ladders.items()} for r in got}
    known = [(r["doc_id"], r["half"], r["lang"], rows[r["doc_id"]][5]) for r in got if not r["base_failed"] and rows[r["doc_id"]][5] is not None]
    count = lambda rule, cut, y: sum(h == 0 and q == y and value[i][rule] > cut for i, h, _, q in known)
    path = quality_rules.learned_path({rule: [(count(rule, c, 1), count(rule, c, 0)) for c in cuts] for rule, (_, cuts) in ladders.items()})
    assert len({rule for rule, _ in path}) >= 2
    first = {i: next((t for t, (rule, k) in enumerate(path) if v[rule] > ladders[rule][1][k]), None) for i, v in value.items()}
    taken = {}
    for lang in ("en", None, "fr"):
        good = [first[i] for i, h, x, q in known if h == 1 and x == lang and q == 1]
        n, t = len(good), 0
        while t < len(path):
            k = sum(f is not None and f <= t for f in good)
            if sum(math.comb(n, j) * 0.03**j * 0.97 ** (n - j) for j in range(k + 1)) > 0.05 / 3:
                break
            t += 1
        taken[lang] = t
    assert taken["fr"] == 0 < min(taken["en"], taken[None])
    for r in got:
        t = first[r["doc_id"]]
        fails = not r["base_failed"] and t is not None and t < taken[r["lang"]]
        assert r["failed_rule"] == (path[t][0] if fails else None) and r["kept"] == (not r["base_failed"] and not fails)
    assert sum(not r["kept"] and rows[r["doc_id"]][5] == 0 for r in got) > 150


# 8


@pytest.mark.parametrize(("k", "t"), [(4, Fraction(85, 100)), (5, Fraction(8, 10))])
def test_join(spark, docs, texts, k, t):
    sets = [shingles(x, k) for x in texts]
    n, up = len(sets), list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, k, t).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_join_in_blocks(spark, monkeypatch):
    """A large group of near copies, compared in many small blocks, and sketches with many zero words."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    rng = random.Random(8)
    base = prose(rng, 60).split(" ")
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 9)}"
        texts.append(" ".join(words))
    test_join(spark, frame(spark, texts), texts, 4, Fraction(85, 100))


def test_join_of_nothing(empty):
    assert jaccard_join.join(empty).count() == 0


def test_sketch_bounds_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, 100)).astype(np.uint64) for _ in range(2))
        h, row = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        words, first = jaccard_join.sketch(h, row, 2, np.asarray([9, 9]), 0)
        apart = int(np.bitwise_count(words[first[0] : first[0] + 10] ^ words[first[1] : first[1] + 10]).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    found = components.components(spark.createDataFrame(edges, "u long, v long"), C.Tables(spark))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: root(x) for x in list(up)}


# 9


def test_token_counts(spark, docs, texts, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.ranked_pieces(P.path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    odd = [*[t or "" for t in texts], "  a", " a b  c ", "▁x", "日本語 テスト", "🙂🙂 a🙂", "\x00a", "aa\n\nb"]
    count = token_counts.Counter(pieces, byte_fallback=False)
    assert [count.of(t) for t in odd] == [len(tok.encode(t, add_special_tokens=False).ids) for t in odd]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect()}
    full = token_counts.Counter(pieces)
    assert got == {i: full.of(t or "") for i, t in enumerate(texts)} and full.of("\U00013000") == 5
    assert token_counts.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_ties_keep_the_longer_last_piece():
    c = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)])
    assert c.segment("▁ab") == (-3.0, 2)  # equal scores: the first candidate for a place, the earliest start, stays


# 10


def test_lines(spark, docs, texts, empty):
    got = {(r["doc_id"], r["line_no"]): (r["kept"], r["keeper_doc_id"], r["keeper_line_no"]) for r in line_dedup.judged(docs).collect()}
    every = [(i, n, x) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    assert set(got) == {(i, n) for i, n, _ in every}
    own = [(i, n, x, frozenset(x[j : j + 5] for j in range(max(1, len(x) - 4)))) for i, n, x in every if x.strip(" \t\n\x0b\f\r")]
    up = list(range(len(own)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(own)):
        for b in range(a):
            if len(own[a][3] & own[b][3]) >= 0.8 * len(own[a][3] | own[b][3]):
                x, y = sorted((root(a), root(b)), key=lambda r: own[r][:2])
                up[y] = x
    least = {}
    for a in range(len(own)):
        least[root(a)] = min(least.get(root(a), own[a][:2]), own[a][:2])
    gone = {own[a][:2] for a in range(len(own)) if least[root(a)] != own[a][:2]}
    mine = {p for p, (kept, _, _) in got.items() if not kept}
    assert mine <= gone and len(mine) >= 0.97 * len(gone)
    assert all(got[p][1:] == p for p in got if p not in mine)
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    for i, t in enumerate(texts):
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in mine)
        if t is not None and left != t and not left.strip():
            assert i not in out
        else:
            assert out[i] == left
    assert line_dedup.dedup(docs).columns == docs.columns and line_dedup.dedup(empty).count() == 0


def test_similar_lines_meet_beside_a_more_frequent_stranger(spark):
    rng, texts, pairs = random.Random(21), [], []
    words = lambda n: ["".join(rng.choices("bcdfghklmn", k=9)) for _ in range(n)]
    for _ in range(20):
        shared = words(11)
        frequent, rare = " ".join(shared + words(3)), " ".join(shared + words(3))
        texts += [frequent] * 5 + [rare, rare[:-1] + "q"]
        pairs.append((len(texts) - 2, len(texts) - 1))
    got = {r["doc_id"]: r["keeper_doc_id"] for r in line_dedup.judged(frame(spark, texts)).collect()}
    assert all(got[i] == got[j] == i for i, j in pairs)


def test_lines_without_spaces_are_signed_whole(spark):
    rng, texts = random.Random(22), []
    for _ in range(8):
        han = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(60))
        texts += [han, chr(rng.randint(0x4E00, 0x9FA5)) + han]
    for _ in range(8):
        url = "https://example.org/" + "".join(rng.choices("abcdefghij", k=60)) + "?page=1"
        texts += [url + "7", url + "8"]
    texts += ["https://example.org/list"] * 20
    for _ in range(8):
        a, b = ("".join(rng.choices("abcdefghij", k=30)) for _ in range(2))
        texts += [f"{a} {b}", f"{a[:3]}X{a[4:]} {b}"]
    got = {r["doc_id"]: r["keeper_doc_id"] for r in line_dedup.judged(frame(spark, texts)).collect()}
    assert all(got[texts.index(x)] == got[i] for i, x in enumerate(texts))
    assert all(got[i] == got[i + 1] == i for i in [*range(0, 32, 2), *range(52, 68, 2)])


def _edited(rng, line, share):
    """The line with about ``share`` of its characters replaced."""
    out = list(line)
    for _ in range(max(1, round(share * len(out)))):
        out[rng.randrange(len(out))] = rng.choice("qxzjk")
    return "".join(out)


@pytest.mark.parametrize("kind", ["words", "few words", "no spaces"])
def test_recall_of_similar_lines(spark, kind):
    """Edits spread over a line bring it near the threshold; nine in ten similar pairs at least must meet, and nothing else."""
    rng, texts = random.Random(kind), []
    for _ in range(150):
        if kind == "words":
            line = " ".join("".join(rng.choices(PARTS, k=rng.randint(1, 3))) for _ in range(rng.randint(14, 60)))
        elif kind == "few words":
            line = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(8, 20))) for _ in range(rng.randint(2, 3)))
        else:
            line = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(rng.randint(30, 90)))
        texts += [line, _edited(rng, line, rng.choice([0.01, 0.02]))]
    sets = [frozenset(x[j : j + 5] for j in range(max(1, len(x) - 4))) for x in texts]
    alike = {i for i in range(0, 300, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    got = {r["doc_id"]: r["keeper_doc_id"] for r in line_dedup.judged(frame(spark, texts)).collect()}
    met = {i for i in range(0, 300, 2) if got[i] == got[i + 1]}
    assert len(alike) > 30 and met <= alike and len(met) >= 0.97 * len(alike)


def test_short_lines_and_blank_lines(spark):
    got = {(r["doc_id"], r["line_no"]): (r["kept"], r["keeper_doc_id"]) for r in line_dedup.judged(frame(spark, ["short dup\n\n \nab", "short dup\n\n \nab", "short dip\nabc"])).collect()}
    assert [p for p, (kept, _) in sorted(got.items()) if not kept] == [(1, 0), (1, 3)] and got[1, 0][1] == got[1, 3][1] == 0


def test_lines_stay_in_the_jvm(docs):
    plan = line_dedup.judged(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# repeated ids and null ids


def _values(found):
    """Rows without the id, as a multiset."""
    return collections.Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items() if k not in ("doc_id", "held_out", "sequence_id", "offset", "component_id"))) for r in found.collect())


def test_rows_with_equal_or_no_ids(spark):
    """What depends on a row's text alone is the same whatever the ids are."""
    P = pytest.importorskip("public_tokenizers")
    rng = random.Random(10)
    texts = [prose(rng, 40), prose(rng, 40), prose(rng, 100), None, "a@b.cd 1.2.3.4", prose(rng, 300)] * 2
    ids = [1, 1, None, None, 2, 2] * 2
    odd, plain = frame(spark, texts, ids=ids), frame(spark, texts)
    none, items = labels(spark, []), spark.createDataFrame([(0, " ".join((texts[0] or "").split()[:20])), (None, texts[1])], "item_id long, text string")
    for run in (
        suffix_dedup.dedup, lambda d: toxicity.score(d, none), lambda d: packing.pack(d, P.path("word_bpe_49k.json")), lambda d: decontaminate.find(d, items), pii.find, lambda d: quality_classifier.score(d, none),
        lambda d: quality_rules.judge(d, none), jaccard_join.join, lambda d: token_counts.token_counts(d, P.path("piece_bpe_32k.model")),
    ):
        assert _values(run(odd)) == _values(run(plain))
    assert all(not r["held_out"] for r in toxicity.score(odd, none).filter("doc_id is null").collect())
    places = collections.Counter((r["sequence_id"], r["offset"]) for r in packing.pack(odd, P.path("word_bpe_49k.json")).collect())
    assert max(places.values()) == 1
    lines = line_dedup.judged(odd).groupBy("doc_id", "line_no").agg(F.countDistinct("kept").alias("n"))
    assert lines.filter("n > 1").count() == 0  # rows of one id and line number share a fate
    texts_left = [r["text"] for r in line_dedup.dedup(frame(spark, ["same line here", "same line here"], ids=[None, 3])).collect()]
    assert texts_left == ["same line here"]


def test_join_with_repeated_and_null_ids(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    texts, ids = [], []
    for family in range(25):
        base = rng.choices(words, k=rng.choice([1, 4, 9, 30, 90, 400]))
        for _ in range(rng.choice([1, 2, 6])):
            x = list(base)
            for _ in range(rng.choice([0, 1, len(x) // 25])):
                x[rng.randrange(len(x))] = rng.choice(words)
            texts.append(" ".join(x))
            ids.append(rng.choice([None, rng.randrange(20)]) if rng.random() < 0.4 else 1000 + len(texts))
    texts, ids = [*texts, None, ""], [*ids, 5000, 5001]
    sets = [shingles(x, 4) for x in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = ids[i] is not None and ids[i] == ids[j]
            if sets[i] and sets[j] and (same or len(sets[i] & sets[j]) * 100 >= 85 * len(sets[i] | sets[j])):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None and sets[i]:
            least[root(i)] = min(d, least.get(root(i), d))
    want = collections.Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, d in enumerate(ids))
    assert collections.Counter(map(tuple, jaccard_join.join(frame(spark, texts, ids=ids)).collect())) == want


# scores by brute force


_M64 = (1 << 64) - 1


def _mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) & _M64
    return x ^ (x >> 31)


def _hash(b, lower=False):
    b = b.lower() if lower else b
    total = sum(int(C._BYTE[x]) * pow(C._BASE, i, 1 << 64) for i, x in enumerate(b))
    return _mixed((total + len(b) * int(C._ODD)) & _M64)


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def test_toxicity_scores_by_brute_force(spark, texts):
    rng = np.random.default_rng(2)
    index = np.arange(1 << toxicity.BITS)
    model = toxicity.Model(index, rng.normal(size=len(index)) * 0.05, -0.3)
    some = [t or "" for t in texts if len(t or "") < 3000] + ["(((((((((( women!!!!!!!!!!!!!!", ".,;", "Ünï"]
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in some])])
    got = model.scores(off, np.frombuffer("".join(some).encode(), np.uint8))
    marks = bytes(np.flatnonzero(toxicity._MARKS).tolist())
    for t, score in zip(some, got, strict=True):
        found = set()
        for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode()):
            if w := w.strip(marks):
                found.add(_hash(w, True) >> (64 - toxicity.BITS))
                found |= {_mixed((_hash(w[:n], True) + n) & _M64) >> (64 - toxicity.BITS) for n in toxicity.BEGINNINGS if len(w) > n}
        assert score == pytest.approx(_sigmoid(model.bias + sum(model.weight[f] for f in found)), abs=1e-9)


def test_quality_scores_by_brute_force(texts):
    rng = np.random.default_rng(3)
    Q = quality_classifier
    model = Q.Model(rng.normal(size=1 << Q.BITS), 0.2)
    some = [t or "" for t in texts if len(t or "") < 1500] + ["日本語テスト 🙂🙂🙂🙂", "a a a"]
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in some])])
    got = model.scores(off, np.frombuffer("".join(some).encode(), np.uint8))
    for t, score in zip(some, got, strict=True):
        words = [_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
        found = [w >> (64 - Q.BITS) for w in words]
        for a, b in zip(words, words[1:], strict=False):
            found.append(int(Q._REPEAT) if a == b else _mixed((a * int(C._MULT[0]) + b * int(C._MULT[1])) & _M64) >> (64 - Q.BITS))
        for n in Q.NGRAMS:
            found += [_mixed((_hash(t[i : i + n].encode()) + n) & _M64) >> (64 - Q.BITS) for i in range(len(t) - n + 1)]
        mean = sum(model.scalar[f] for f in found) / len(found) if found else 0
        assert score == pytest.approx(_sigmoid(model.bias + mean), abs=1e-9)


def test_items_in_blocks(spark, docs, texts):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t and len(t) < 4000], "item_id long, text string")
    one, many = decontaminate.find(docs, items), decontaminate.find(docs, items, most_broadcast=3000)
    key = lambda r: (r["doc_id"], r["item_ids"], r["contaminated"])
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))
    clean = {r["doc_id"] for r in one.collect() if not r["contaminated"]}
    for size in (4_000_000, 3000):
        kept = decontaminate.keep_clean(docs, items, most_broadcast=size)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean


def test_without(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "doc_id long, own_gone string, _own_gone int")
    gone = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    for most in (10, 0):
        assert sorted(r["own_gone"] for r in C.without(df, gone, most).collect()) == ["b", "c"]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Bare:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Bare()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(Session())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_repeats_of_the_whole_table(spark):
    """The query over all of sf0.01 against suffix-free brute force by window hashes."""
    from lodestone.llm import queries

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    data = [(r["text"] or "").encode() for r in table]
    seen, windows = collections.Counter(), []
    for b in data:
        raw = np.frombuffer(b, np.uint8)
        start = np.arange(max(0, len(b) - 399))
        windows.append(C.Prefix(raw)(start, start + 400).tolist() if len(start) else [])
        seen.update(windows[-1])
    want = {}
    for r, b, own in zip(table, data, windows, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i, h in enumerate(own):
            if seen[h] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[r["doc_id"]] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op1_suffix_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


# the pipeline


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(11)
    items = [prose(rng, 30) for _ in range(5)]
    clean = [prose(rng, 80) for _ in range(40)]
    bad = [prose(rng, 60) + " vilkan grumsel vilkan" for _ in range(40)]
    leaks = [prose(rng, 60) + " " + items[i] + " " + prose(rng, 20) for i in range(5)]
    near = [c.replace(c.split(" ")[5], "changed", 1) for c in clean[:3]]
    texts = [*clean, *bad, *leaks, *clean[:4], *near, None, ""]
    frame(spark, texts).select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(i, 1, int(40 <= i < 80)) for i in range(85)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen.append((name, {r["doc_id"] for r in docs.select("doc_id").collect()}))
    after = dict(seen)
    assert set(range(40)) <= after["toxicity"] and len(after["toxicity"] & set(range(40, 80))) <= 2
    assert set(range(40)) <= after["jaccard_join"] and not after["jaccard_join"] & set(range(85, 89))
    assert not after["decontamination"] & set(range(80, 85)) and set(range(40)) <= after["decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} == after["packing"]


def test_pipeline_of_nothing_and_odd_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = frame(spark, ["x y z\nx y z\nmore", "x y z", None, ""]).withColumns({c: F.lit(c) for c in ("_kept", "_doc", "_text", "_gone", "own_doc", "own_text", "own_fate", "own_gone")})
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    left = {r["doc_id"]: (r["text"], r["_text"], r["own_fate"]) for r in docs.collect()}
    assert left[0] == ("x y z\nmore", "_text", "own_fate") and 1 not in left and set(left) == {0, 2, 3}


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """What the line, similarity and benchmark stages keep, each recomputed from its own input."""
    import corpus_pipeline

    texts = corpus(31, 30)
    items = [t for t in texts if t and 20 < len(t.split()) < 80][:3]
    labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, docs = dict(corpus_pipeline.STAGES), frame(spark, texts)

    def kept(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    docs, after = kept("line_dedup", docs)
    gone = {(r["doc_id"], r["line_no"]) for r in line_dedup.judged(frame(spark, texts)).filter("not kept").collect()}
    for i, t in enumerate(texts):
        left = t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        assert after.get(i) == left if t is None or left == t or left.strip() else i not in after
    before = after
    docs, after = kept("jaccard_join", docs)
    sets, up = {i: shingles(t, 5) for i, t in before.items()}, {i: i for i in before}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert set(after) == {i for i in before if root(i) == i}
    before = after
    docs, after = kept("decontamination", docs)
    bare = lambda t: " ".join(w for x in WORD.findall(t or "") if (w := x.strip(".,;:!?\"'()[]{}|*#$%&<>")))
    found = {i for i, t in before.items() for q in items if shingles(bare(q), 5) and 10 * len(shingles(bare(q), 5) & shingles(bare(t), 5)) >= 8 * len(shingles(bare(q), 5))}
    assert set(after) == set(before) - found and found


def test_bands_of_lines_are_shuffled_once(spark, tmp_path):
    """Counting the names of a key and joining them with its hub read one shuffle; before, each had its own."""
    rows = [(n, n, [[n % 7, 100 + n % 5, None]]) for n in range(60)] + [(99, 99, [[1000, None, 1001]])]
    spark.createDataFrame(rows, "name long, place long, keys array<array<long>>").write.parquet(str(tmp_path / "t"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        band = line_dedup._bands(spark.read.parquet(str(tmp_path / "t")))
        met = line_dedup._met(band, line_dedup._shared(band, "name"))
        plan = met._jdf.queryExecution().executedPlan().toString()
        got = {(r["key"], r["name"], r["hub"]) for r in met.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ReusedExchange") == 1  # it is shown with the one that it reads
    assert got == {(n % 7, n, n % 7) for n in range(60)} | {(100 + n % 5, n, n % 5) for n in range(60)}

"""The corpus operators against brute force and round trips, with nulls, empty and repeated rows, and clashing columns."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from scholion.llm import bpe, decontam, distinct, langid, neardup, ppm, quality, spans, topk, toxicity, urlfilter, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(x):
    return [w.translate(LOWER) for w in re.findall("[^\x20\x09-\x0d]+", x or "")]


def docs(spark, rows, kinds="doc_id bigint, text string"):
    """With an extra column whose name clashes with the operators' own."""
    return spark.createDataFrame([(*r, "x") for r in rows], kinds + ", score string").repartition(3)


# ---- WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "one"), (2, "http://b/\r\nX: y", "one"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000), (5, "u", "é" * 5000), (None, "n", "one"), (-7, "m", "minus")]
    got = {(r.page_id, r.payload_digest): r for r in warc.round_trip(spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string")).collect()}
    sha = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    assert all(r.error is None for r in got.values())
    assert (got[1, sha("one")].record_type, got[1, sha("one")].refers_to, got[1, sha("one")].payload_bytes) == ("revisit", 2, 3)
    assert got[2, sha("one")].record_type == "response" and got[None, sha("one")].refers_to == 2
    assert (got[3, sha("")].record_type, got[3, sha("")].refers_to, got[4, sha("")].record_type) == ("revisit", 4, "response")
    assert got[5, sha("é" * 5000)].payload_bytes == 10000 and got[-7, sha("minus")].record_type == "response"
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_archive_form_and_faults():
    records = [warc.record("response", warc.record_id(i), "u", "1970-01-01T00:00:00Z", b"<p>%d</p>" % i * 200, None) for i in range(300)]
    whole = warc.archive(records)
    magic, size = struct.unpack_from("<II", whole)
    assert magic == warc.DICTIONARY_MAGIC and 8 + size < len(whole)
    assert [f for _, f, e in warc.frames(pa.py_buffer(whole)) if e is None] == records
    assert [e for _, _, e in warc.frames(pa.py_buffer(whole[:-3]))][-1] == "truncated frame"
    plain = struct.pack("<II", warc.DICTIONARY_MAGIC, 4) + b"abcd" + zstandard.ZstdCompressor().compress(b"x")  # a raw dictionary
    assert [f for _, f, _ in warc.frames(pa.py_buffer(plain))] == [b"x"]
    good = records[0]
    for bad, why in ((good.replace(b"Content-Length: ", b"Content-Length: 9", 1), "Content-Length"), (good[:-1], "Content-Length"), (good.replace(b"WARC/1.1", b"WARK/1.1"), "version"), (good.replace(b"WARC-Date", b"X-Date"), "no warc-date"), (good.replace(b"<p>0", b"<p>9"), "digest")):
        assert (warc.parse(bad)["error"] or "").find(why.split()[0]) >= 0, why
    assert all(warc.page_id(warc.record_id(i)) == i for i in (0, 1, -1, 2**63 - 1, -(2**63), None))


def test_warc_reading_goes_on_behind_damage():
    records = [warc.record("response", warc.record_id(i), "u", "1970-01-01T00:00:00Z", b"<p>%d</p>" % i * 50, None) for i in range(100)]
    whole = warc.archive(records)
    places = [at for at, _, _ in warc.frames(pa.py_buffer(whole))]
    for damage in (b"\0" * 12, b"\xff"):  # the frame's magic and header; a byte within it
        bad = bytearray(whole)
        at = places[10] + (0 if len(damage) > 1 else 30)
        bad[at : at + len(damage)] = damage
        got = list(warc.frames(pa.py_buffer(bytes(bad))))
        assert [f for _, f, e in got if e is None] == records[:10] + records[11:] and sum(e is not None for _, _, e in got) == 1
    cut = whole[: places[50] + 9] + whole[places[51] :]  # a frame that ends too soon
    got = list(warc.frames(pa.py_buffer(cut)))
    assert [f for _, f, e in got if e is None] == records[:50] + records[51:] and sum(e is not None for _, _, e in got) == 1
    assert [e is None for _, _, e in warc.frames(pa.py_buffer(b"nothing of the kind"))] == [False] and not list(warc.frames(pa.py_buffer(b"")))
    twice = records[0].replace(b"WARC-Date", b"WARC-Type: revisit\r\nWARC-Date", 1)
    assert "repeated warc-type" in warc.parse(twice)["error"]
    again = records[0].replace(b"WARC-Date", b"WARC-Concurrent-To: a\r\nWARC-Concurrent-To: b\r\nWARC-Date", 1)
    assert warc.parse(again)["error"] is None


# ---- quality, toxicity, language


def _labelled(spark):
    rnd = random.Random(1)
    common = [f"word{i}" for i in range(80)]
    rows, labels = [(None, "word1 word2"), (10_000, None), (10_001, "")], []
    for i in range(400):
        body = [rnd.choice(common) for _ in range(rnd.randint(20, 60))]
        poor, bad = i % 5 == 0, i % 4 == 1
        if bad:
            body[3:3] = rnd.sample(["vile", "nasty", "foul"], 2)
        rows.append((i, " ".join(w.upper() + "!!" for w in body) if poor else " ".join(body)))
        labels.append((i, int(not poor), int(bad), "x"))
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 1, "x"), (7, None, None, "x")], "doc_id bigint, quality int, toxic int, text string")


def test_quality_held_out(spark):
    d, labels = _labelled(spark)
    got = quality.score(d, quality.graded(labels)).collect()
    assert len(got) == 403
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and np.mean([r.kept == (r.doc_id % 5 != 0) for r in held]) > 0.97
    assert all(a >= b for r in got for a, b in zip(r.tails, r.tails[1:]))  # ordered thresholds
    assert quality.keep(d, quality.graded(labels)).columns == d.columns
    assert all(r.kept for r in quality.score(d, quality.graded(labels.limit(0))).collect())
    assert quality.score(d.limit(0), quality.graded(labels)).count() == 0


def test_toxicity_held_out(spark):
    d, labels = _labelled(spark)
    got = toxicity.score(d, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(got) == 403 and np.mean([r.predicted == int(r.doc_id % 4 == 1) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and all(r.neighbours for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert {r.score for r in toxicity.score(d, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(d.limit(0), labels).count() == 0


def _stems(x):
    return Counter(w[:4] for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (x or "").translate(LOWER)))


def test_toxicity_against_brute_force(spark):
    """Neighbours, cosines and scores of the whole query, by comparing every text with every example."""
    rnd = random.Random(3)
    common = [f"w{i}rd{i % 7}" for i in range(60)] + ["überaus", "漢字漢字漢字", "idiot", "idiotic"]
    rows = [(i, " ".join(rnd.choice(common) for _ in range(rnd.randint(0, 25)))) for i in range(150)]
    rows += [(150, rows[9][1]), (151, rows[9][1].upper()), (151, "zz idiot"), (152, None), (153, ""), (154, "unheard"), (None, "idiot"), (3, "aaaa second text of the id"), (155, "w1rd1 " * 300_000)]
    labels = [(i, int("idiot" in (x or ""))) for i, x in rows[:153]] + [(None, 1), (7, None), (155, 1)]
    d = docs(spark, rows)
    lab = spark.createDataFrame([(*x, "x") for x in labels], "doc_id bigint, toxic int, text string")
    k = 4
    got = toxicity.score(d, lab, k=k, evidence=k).collect()
    hold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    taught = {(i, y) for i, y in labels if i is not None and y is not None and not hold(i)}
    texts = defaultdict(list)
    for i, x in rows:
        if len(x or "") <= 1 << 18:
            texts[i].append(x or "")
    examples = sorted((i, y, min(texts[i])) for i, y in taught if texts[i])
    known = {t for _, _, x in examples for t in _stems(x)}
    df = Counter(t for _, x in rows for t in _stems(x) if t in known)
    n = len(rows)

    def unit(x):
        v = {t: (1 + math.log(c)) * math.log(1 + n / (df[t] + 0.01 * n)) ** 2 for t, c in _stems(x).items() if t in known}
        norm = math.sqrt(sum(a * a for a in v.values()))
        return {t: a / norm for t, a in v.items()}

    units = [unit(x) for _, _, x in examples]
    share = lambda v, without=-1: sorted(((-round(c, 12), j) for j, u in enumerate(units) if j != without and (c := sum(a * u.get(t, 0) for t, a in v.items())) > 1e-12))[:k]

    def vote(near):
        w = [1 / (1.05 - min(-c, 1.0)) for c, _ in near]
        return sum(a * examples[j][1] for a, (_, j) in zip(w, near)) / sum(w)

    loo = [share(u, i) for i, u in enumerate(units)]
    votes = [(vote(x), examples[i][1], 1) for i, x in enumerate(loo) if x]
    left, value = toxicity.monotone(*(np.array(x, float) for x in zip(*votes)))
    rest = sum(y for _, y, _ in examples) / len(examples)
    want = []
    for i, x in rows:
        near = share(unit(x))
        want.append((str(i), round(rest if not near else float(np.interp(vote(near), left, value)), 9), [(examples[j][0], examples[j][1], round(-c, 9)) for c, j in near]))
    found = [(str(r.doc_id), round(r.score, 9), [(e.doc_id, e.label, round(e.cosine, 9)) for e in r.neighbours]) for r in got]
    assert [x[2] for x in sorted(found, key=repr)] == [x[2] for x in sorted(want, key=repr)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert len({x[1] for x in found}) > 3
    assert not any(e.doc_id == 155 for r in got for e in r.neighbours)  # longer than an example may be


def test_index_finds_exact_neighbours():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        rows.append((t, w / np.sqrt((w * w).sum())))
    rows[300:310] = [rows[7]] * 10  # ties
    index = toxicity.Index(rows, 40, 8)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for i in range(0, 500, 7):
        ids, near = next(index.search([rows[i]], 9, [i]))
        all_ = np.round(dense @ dense[i], 12)
        all_[i] = 0
        want = [j for j in np.lexsort((np.arange(500), -all_))[:9] if all_[j] > 0]
        assert ids.tolist() == want and np.allclose(near, all_[want])


def test_language_brute_force_and_cases(spark):
    rnd = random.Random(4)
    sets = {"xx": ["lorem", "dolor", "amet", "sit"], "yy": ["gruß", "über", "straße", "öl"], "zz": ["kala", "talo", "yksi", "käsi"]}
    rows = [(i, " ".join(rnd.choice(sets[k]) for _ in range(30)), k) for i, k in enumerate([*sets] * 30)] + [(1000, None, "xx"), (1001, " 12 !", "xx"), (None, "lorem", None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, score string").repartition(3)
    got = {r.doc_id: r for r in langid.predict(d).collect()}
    assert all(got[i].lang_pred == k for i, x, k in rows[:90]) and got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    assert langid.keep(d).count() == len(rows) - 2
    text = "Ab c-d"
    grams = {g for w in ("ab", "c", "d") for n in range(1, 5) for g in [(" " + w + " ")[i : i + n] for i in range(len(w) + 3 - n)] if g.strip()}
    buf, off = spans.utf8(pa.array([text, "", "ab c d"]))
    a, b, c = (x.tolist() for x in langid.ngrams(buf, off))
    assert len(set(a)) == len(grams) and not b and sorted(a) == sorted(c)
    assert {r.lang_pred for r in langid.predict(d.limit(0).unionByName(d.where("doc_id is null"))).collect()} == {"und"}


# ---- urls


def test_url_rules_brute_force(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.example.net", "/en/x"), ("allow", "org", ""), ("block", "b.org", "/q"), ("block", None, "/"), ("block", "", "/")]
    rules += [("block", "deep.com", "/" + "a" * n) for n in range(0, 40, 3)] + [("allow", "deep.com", "/a/"), ("allow", "DEEP.com", "/aaa"), ("allow", "x.y.z.deep.com", "/"), ("block", "y.z.deep.com", None)]
    hosts = ["net", "Example.net", "a.example.net", "z.a.EXAMPLE.net", "org", "b.org", "bb.org", "xexample.net", "c.b.org", "com", "", "a..net", "net.", "deep.com", "q.deep.com", "w.x.y.z.deep.com", "z.deep.com"]
    paths = ["", "/", "/en/", "/en/x/y", "/q?u", "#f", "?x=/en/", "/" + "a" * 17, "/" + "a" * 12 + "b", "/a/b", "/é"]
    urls = [(i, u) for i, u in enumerate([None, "no", "//x", *(f"http://{h}{p}" for h in hosts for p in paths)])] + [(None, "http://net/"), (3, "http://net/"), (3, "http://net/")]
    got = urlfilter.judge(spark.createDataFrame([(*u, "x") for u in urls], "page_id bigint, url string, key string"), urlfilter.rules(spark, rules)).collect()
    assert len(got) == len(urls)

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in ((v, (h or "").lower(), p or "") for v, h, p in rules) if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, "allow", None))
        return host, path, best[3], best[2]

    expected = Counter((i, *want(u)) for i, u in urls)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == expected
    assert urlfilter.judge(spark.createDataFrame([], "page_id bigint, url string"), urlfilter.rules(spark, rules)).count() == 0
    assert {r.verdict for r in urlfilter.judge(spark.createDataFrame(urls, "page_id bigint, url string"), urlfilter.rules(spark, [])).collect()} == {"allow"}


# ---- tokens


def test_pretokens_equal_the_pattern():
    import regex

    pattern, rnd = regex.compile(public_tokenizers.PATTERN), random.Random(5)
    for _ in range(1500):
        texts = ["".join(rnd.choice("ab s't're ve l ll'd  \n\t'é1٣ 漢!?　\xa0m'") for _ in range(rnd.randint(0, 14))) for _ in range(4)]
        buf, off = spans.utf8(pa.array(texts))
        at = bpe.pretokens(buf, off)
        assert [bytes(buf[a:b]).decode() for a, b in zip(at[:-1], at[1:])] == [w for t in texts for w in pattern.findall(t)]


def test_bpe_round_trip(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    rows = [(1, "Hello  world's\n\n end "), (2, None), (3, ""), (4, "naïve 漢字 🙂 ₂" * 300), (4, "naïve 漢字 🙂 ₂" * 300), (None, "x" * 5000)]
    enc = bpe.encode(docs(spark, rows), PATH)
    got = sorted((str(r.doc_id), r.ids) for r in enc.collect())
    assert got == sorted((str(i), own.encode_ordinary(x or "")) for i, x in rows)
    assert sorted(r.decoded for r in bpe.decode(enc, PATH).collect()) == sorted((x or "").encode() for _, x in rows)
    d = {r.doc_id: r for r in bpe.digests(enc, PATH).collect()}
    assert d[1].ids_sha256 == hashlib.sha256(",".join(map(str, own.encode_ordinary(rows[0][1]))).encode()).hexdigest() and d[2].n_tokens == 0 and d[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(docs(spark, rows).limit(0), PATH).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), PATH).collect()


# ---- decontamination


def _distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join("".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    items = [(i, text(30)) for i in range(8)] + [(100, "short one"), (101, None), (102, ""), (100, "short one")]
    rows = [(None, items[0][1]), (900, None), (901, ""), (902, "a Short\tone here"), (903, "ashort one")]
    for n in range(120):
        t = list(items[n % 8][1])
        for _ in range(int(len(t) * rnd.choice([0, 0.03, 0.06, 0.1, 0.5]))):
            t[rnd.randrange(len(t))] = rnd.choice("abc ")
        rows.append((n, text(40) + " " + "".join(t).upper() + " " + text(20)))
    rows.append((3, rows[-1][1]))
    d, b = docs(spark, rows), spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, score string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(d, b).collect()}
    want = {}
    for i, x in rows:
        for j, y in items[:8]:
            flat = re.sub("[\x20\x09-\x0d]", " ", (x or "").translate(LOWER))
            if flat and (n := _distance(y, flat)) <= 0.2 * len(y):
                want[i, j] = min(n, want.get((i, j), 999))
    assert {k: v for k, v in got.items() if k[1] < 100} == want  # recall 1 up to ten edits in a hundred
    assert sorted((k[0], d) for k, d in got.items() if k[1] == 100) == [(902, 0), (903, 1)] and not any(k[1] > 100 for k in got)
    kept = {r.doc_id for r in decontam.clean(d, b).collect()}
    assert kept == {i for i, _ in rows if not any(k[0] == i for k in got)}
    assert decontam.matches(d, b.limit(0)).count() == 0
    assert {k for k in got} == {(r.doc_id, r.item_id) for r in decontam.matches(d, b, slice_bytes=300).collect()}


@pytest.mark.parametrize(("low", "high"), [(32, 48), (49, 100), (101, 200), (201, 260)])
def test_decontamination_recall_up_to_the_allowance(low, high):
    """Recall against exact search for every share of edits, by length of the items."""
    rnd, rng = random.Random(7), np.random.default_rng(7)
    text = lambda n: " ".join("".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    items = decontam.Items([(i, text(70)[: rnd.randint(low, high)].strip().ljust(low, "e")) for i in range(60)], 0.8, 32)
    rows, of = [], []
    for n, (_, x) in enumerate(items.rows):
        for share in (0.08, 0.12, 0.16, 0.19, 0.2) * 3:
            copy = decontam.edited(np.frombuffer(x, np.uint8), int(share * len(x) + 1e-9), rng).tobytes()
            rows.append(text(10).encode() + b" " + copy + b" " + text(10).encode())
            of.append((n, share))
    got = items.found(*spans.utf8(pa.array(rows, pa.binary())))
    cells = defaultdict(list)
    for (n, share), row, found in zip(of, rows, got, strict=True):
        d = decontam.best_place(items.rows[n][1], row)[0]
        if d <= items.allowed[n]:
            cells[share].append(any(g[:2] == (n, d) for g in found))
    assert len(cells) == 5 and all(len(c) > 100 and sum(c) >= 0.9 * len(c) for c in cells.values()), {k: sum(c) / len(c) for k, c in cells.items()}
    assert all(g[1] <= items.allowed[g[0]] for f in got for g in f)


def test_decontamination_of_short_items():
    items = decontam.Items([(0, "short one"), (1, "一二三四五"), (2, "what?"), (3, "a"), (4, "zz")], 0.8, 32)
    rows = ["a (short one), b", 'the "short one"?', "short\n  one", "中short one文", "ashort one", "short ones", "éshort one", "零一二三四五六", "so what? yes", "一二三四六", ""]
    got = [[(g[0], g[1]) for g in f if g[0] != 3] for f in items.found(*spans.utf8(pa.array(rows)))]
    assert got == [[(0, 0)]] * 4 + [[(0, 1)]] * 2 + [[], [(1, 0)], [(2, 0)], [(1, 3)], []]
    assert [any(g[0] == 3 for g in f) for f in items.found(*spans.utf8(pa.array(rows)))] == [True] + [False] * 10


def test_short_items_against_brute_force():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcé漢") for _ in range(rnd.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rnd.randint(1, 4)))[:10] for _ in range(40)]
    items = decontam.Items([(i, x) for i, x in enumerate(texts) if 0 < len(x.strip().encode()) < 32], 0.8, 32)
    rows = [rnd.choice(["", " ", "(", "é"]).join(rnd.choice([word(), rnd.choice(texts), rnd.choice(texts)[1:], rnd.choice(texts) + "b"]) + rnd.choice([" ", "  ", ". "]) for _ in range(rnd.randint(0, 6))) for _ in range(120)]
    got = items.found(*spans.utf8(pa.array(rows)))
    assert sum(map(len, got)) > 200

    def want(x):
        flat = np.frombuffer(re.sub(b" +", b" ", decontam.BLANK[np.frombuffer(x.encode(), np.uint8)].tobytes()), np.uint8)
        can = np.flatnonzero(decontam.edges(flat, np.array([0, len(flat)]))).tolist()
        out = []
        for n, (_, item) in enumerate(items.rows):
            near = [d for a in can for b in can if a < b and abs(b - a - len(item)) <= items.allowed[n] for d in [_whole(item, flat[a:b].tobytes())] if d <= items.allowed[n]]
            if near:
                out.append((n, min(near)))
        return out

    assert [[(g[0], g[1]) for g in f] for f in got] == [want(x) for x in rows]


def _whole(item, text):
    prev = list(range(len(text) + 1))
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


# ---- language model


def test_ppm_against_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "sat", "Über", "ünd"]) for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(100, None), (None, "The cat"), (101, ""), (5, "cat cat")]
    d = docs(spark, rows)
    hold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    trie, counts = defaultdict(Counter), Counter()
    for i, x in rows:
        if not hold(i):
            counts.update([*words(x), ""])
            s = bytes([254] * 4) + (x or "").encode() + b"\xff"
            for p in range(4, len(s)):
                for k in range(5):
                    trie[s[p - k : p]][s[p]] += 1

    def log_p(s, p):
        out, excluded = 0.0, set()
        for k in range(4, -1, -1):
            left = {y: n for y, n in trie.get(s[p - k : p], {}).items() if y not in excluded}
            if left:
                total = sum(left.values()) + len(left)
                if s[p] in left:
                    return out + math.log10(left[s[p]] / total)
                out += math.log10(len(left) / total)
                excluded |= set(left)
        return out - math.log10(256 - len(excluded))

    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(words(x)) + 1, sum(counts[w] > 0 for w in [*words(x), ""]), hold(i), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(x), ""]), 6), round(sum(log_p(bytes([254] * 4) + (x or "").encode() + b"\xff", p) for p in range(4, 5 + len((x or "").encode()))), 3)) for i, x in rows)
    for block in (distinct.BLOCK, 100):
        monkeypatch.setattr(distinct, "BLOCK", block)
        got = ppm.score(d).collect()
        assert {r.train_tokens for r in got} == {n}
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6), round(r.score, 3)) for r in got) == want
    assert ppm.score(d.limit(0)).count() == 0


# ---- n-gram join


def _brute(rows, k, t):
    own = {i: ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}) for i, x in rows for w in [words(x)]}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in own:
        for b in own:
            if a < b and (both := len(own[a] & own[b])) and 100 * both >= t * len(own[a] | own[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in own}


@pytest.mark.parametrize(("k", "t", "common"), [(4, 85, 64), (5, 80, 3)])
def test_join_against_brute_force(spark, k, t, common):
    rnd = random.Random(k)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 12, 30, 60, 120]))] for _ in range(15)]
    rows = []
    for n in range(250):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((n + 5, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A b"), (1004, "A b")]
    d = docs(spark, rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.join(d, k, t, common).collect()} == _brute(rows, k, t)
    kept = neardup.one_of_each(d, k, t)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for i, (n, c) in _brute(rows, k, t).items()})


def test_join_cases(spark):
    got = neardup.join(docs(spark, [(None, "a b c d e f g"), (3, "a b c d e f g"), (2, "a b c d e f g")])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("2", 2), ("3", 2), ("None", None)]
    assert neardup.join(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_sketch_bounds_the_overlap():
    rng = np.random.default_rng(3)
    for n in (10, 700, 6000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**63, n // 7).astype(np.uint64))))
        assert neardup.most_common(len(a), len(b), neardup.sketch(a), neardup.sketch(b)) >= len(np.intersect1d(a, b))


def test_boundary_prefers_pairs_only_where_lists_cost_more():
    assert neardup.boundary({500: 1000}, 85, 0.0) == 0
    assert neardup.boundary({6: 1000, 500: 10}, 85, 1.0) == 499


# ---- top products


def test_top_products_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 9)]) for i in range(300)] + [(300, [0.1] * 9), (301, [0.1] * 9), (301, [0.1] * 9), (None, [0.1] * 9), (350, None), (400, [0.1, None] + [0.0] * 7), (450, [float("nan")] * 9), (500, [1.0] * 3), (501, [2.0] * 3), (550, [])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int").repartition(3)
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = []
    for i, v in usable:
        if i % 50 == 0:
            order = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v)))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(order, 1)]
    with pytest.raises(Exception, match="too large"):
        topk.top(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id bigint, embedding array<float>")).collect()
    many = spark.createDataFrame([(0, [1.0, 0.0])] * 3 + [(7, [2.0, 1.0])] * 400 + [(8, [3.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in topk.top(many, block=64).orderBy("rank").collect()] == [(1, 8)] + [(n, 7) for n in (2, 3, 4, 5)]
    for block in (64, 8192):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top(d, block=block, group=3).collect())
        assert got == sorted(want)
    assert topk.top(d.limit(0)).count() == 0

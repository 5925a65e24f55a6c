"""The corpus pipeline: every stage on nulls, repeats, ties, long and empty texts, empty tables and clashing columns, and the
stages' decisions against plain re-computations."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from scholion.llm import bpe, langid, quality, spans  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}
LANGUAGES = {"en": "the cat sat with that thing and other words near some house", "de": "der hund und die katze gehen schnell über straße nach hause", "fr": "le chat est dans la maison avec les autres mots où il dort"}
#: Extra columns with the names that the operators use inside.
CLASH = ("doc", "label", "cid", "n", "score", "kept", "weight", "grade", "part", "block", "sig", "lang_pred", "component_id")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
PASSAGE = "what is the seventh letter of the old alphabet that nobody in this small town remembers any more today"


def rows():
    rnd = random.Random(5)
    out = []
    for i in range(240):
        lang = rnd.choice(list(LANGUAGES))
        words = [rnd.choice(LANGUAGES[lang].split()) + rnd.choice(["", "", "e", "s", "er"]) for _ in range(rnd.randint(25, 60))]
        if i % 6 == 0:
            words = [w.upper() + "!!" for w in words]
        out.append([i, " ".join(words), lang])
    for i in range(60):  # exact and near copies
        text = out[rnd.randrange(200)][1].split(" ")
        if i % 2:
            text[rnd.randrange(len(text))] = "changed"
        out.append([1000 + i, " ".join(text), "en"])
    for i in range(10):
        out.append([2000 + i, f"{out[i][1]} {PASSAGE if i % 2 else PASSAGE.replace('seventh', 'sixth')} {out[i + 30][1]}", "en"])
    out += [[3000, None, "en"], [3001, "", "en"], [3002, " \n", None], [3003, "12 34 !!", "de"], [3004, "漢字" * 40, None], [3005, "Это русский текст о словах и доме где спит кот " * 3, None], [None, out[7][1] + " once more", "en"], [None, out[7][1] + " once more", "en"]]
    out += [list(out[4]), list(out[4]), [4, "another text of the id " + out[9][1], "en"], [3006, " ".join(rnd.choice(LANGUAGES["en"].split()) + str(rnd.randrange(50)) for _ in range(150_000)), "en"]]
    return [tuple([*r, "s", len(r[1] or "")] + ["x"] * len(CLASH)) for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = rows()
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], int(r[0] % 6 != 0), int(r[0] % 5 == 0), "x") for r in docs if r[0] is not None and r[0] < 240] + [(None, 1, 0, "x"), (3, None, None, "x")]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE, "x"), (2, None, "x"), (3, "", "x")], "item_id bigint, text string, doc_id string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows that each stage kept, in order."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        out[name] = (docs, got.columns, got.collect())
        docs = corpus_pipeline.table(got, name) if name != corpus_pipeline.STAGES[-1][0] else docs
    return out


def test_stages_keep_the_columns(spark, folder, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "byte_bpe"]
    for name, (docs, columns, _) in list(stages.items())[:-1]:
        assert columns == docs.columns, name
    want = Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in stages["byte_bpe"][2])
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == want


def _profile(texts):
    """Counts of the n-grams of 1 to 4 letters, words between blanks, by plain string operations."""
    out = Counter()
    for x in texts:
        for word in re.findall(r"[^\W\d_]+", x.lower()):
            w = f" {word} "
            out.update(w[i : i + n] for n in range(1, 5) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    return out


def test_language_against_strings(spark, folder, stages):
    """N-grams and their ranks, distances and the choice of language; ties of frequency may stand in any order, so places are
    compared between the first and last place that a tie allows."""
    docs, _, kept = stages["language"]
    got = {r.doc_id: r for r in langid.predict(docs).collect() if r.doc_id is not None}
    hold = lambda i: i is not None and __import__("zlib").crc32(str(i).encode()) % 4 == 2
    source = docs.select("doc_id", "text", "lang").collect()
    profiles = {}
    for lang in LANGUAGES:
        counts = _profile(r.text for r in source if r.lang == lang and r.text and not hold(r.doc_id))
        profiles[lang] = counts
    checked = 0
    for r in source:
        if r.doc_id is None or not r.text or not re.search(r"[^\W\d_]", r.text) or r.doc_id == 4 or len(r.text) > 10_000:
            continue
        own = _profile([r.text])
        if len(own) > 300:  # which of equally frequent ones are among the first 300 is the hash's choice
            continue
        low, high = {}, {}
        for lang, counts in profiles.items():
            place = {}
            for table, names in ((own, "own"), (counts, "theirs")):
                order = sorted(table.values(), reverse=True)
                first = {n: order.index(n) for n in set(order)}
                place[names] = {g: (first[n], first[n] + order.count(n) - 1) for g, n in table.items()}
            a = b = 0
            for g, (x, y) in place["own"].items():
                u, v = place["theirs"].get(g, (10**9, 10**9))
                if u >= 300:
                    a, b = a + 300, b + 300
                else:
                    near = max(0, u - y, x - v)
                    a, b = a + near, b + (300 if v >= 300 else max(abs(u - y), abs(v - x)))
            low[lang], high[lang] = a / (300 * len(own)), b / (300 * len(own))
        best = got[r.doc_id].lang_pred
        assert low[best] - 1e-9 <= got[r.doc_id].distance <= high[best] + 1e-9
        if min(high[x] for x in high if x == best) < min(low[x] for x in low if x != best):
            assert best == min(low, key=low.get)
        checked += 1
    assert checked > 100
    assert all(got[r.doc_id].lang_pred == r.lang for r in source if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 4)
    gone = {r.doc_id for r in source} - {r.doc_id for r in kept}
    assert gone == {3000, 3001, 3002, 3003, 3004, 3005}  # no letters, or letters of no learnt language
    assert len(kept) == len(source) - 6


def test_quality_gradient_and_optimum():
    """The likelihood's gradient against differences, and thresholds and weights against a plain search on a small case."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    grades = np.clip(np.round(x + rng.normal(0, 0.7, 60) + 1), 0, 2).astype(int)
    feats = [(np.array([3]), np.array([v])) for v in x]
    weight = np.ones(60)

    def loss(w, t1, gap, ridge=1e-2):
        t = np.array([t1, t1 + np.exp(gap)])
        upper = np.concatenate((np.ones((60, 1)), quality.logistic(w * x[:, None] - t), np.zeros((60, 1))), axis=1)
        own = upper[np.arange(60), grades] - upper[np.arange(60), grades + 1]
        return -np.log(np.maximum(own, 1e-12)).mean() + ridge * w * w / 2

    w, t = quality.train(feats, grades, weight, 3, steps=4000, ridge=1e-2)
    found = loss(w[3], t[0], np.log(t[1] - t[0]))
    best, at = found, [w[3], t[0], np.log(t[1] - t[0])]
    step = 0.2
    while step > 1e-4:  # coordinate search from what was found
        better = min(((loss(*(at[:i] + [at[i] + s] + at[i + 1 :])), i, s) for i in range(3) for s in (step, -step)), key=lambda z: z[0])
        if better[0] < best - 1e-12:
            best, at[better[1]] = better[0], at[better[1]] + better[2]
        else:
            step /= 2
    assert found - best < 1e-3 and t[0] < t[1]
    for i in range(3):  # no slope is left
        h = 1e-4
        p = [w[3], t[0], np.log(t[1] - t[0])]
        up, down = p.copy(), p.copy()
        up[i], down[i] = up[i] + h, down[i] - h
        assert abs(loss(*up) - loss(*down)) / (2 * h) < 2e-2


def _features(text):
    """A text's features by plain string operations: words and shapes by their share, statistics by half."""
    kind = lambda c: 0 if c >= 128 or 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3
    room = (1 << quality.BITS) - 1
    out = defaultdict(float)
    found = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    for w in found:
        out[int(spans.hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0]) & room] += 1 / len(found)
        shape = kind(w[0]) + 4 * kind(w[min(1, len(w) - 1)]) + 16 * kind(w[max(len(w) - 2, 0)]) + 64 * kind(w[-1]) + 256 * min(len(w), 24) + (1 << 40)
        out[int(spans.mix(np.array([shape], np.uint64))[0]) & room] += 1 / len(found)
    n, whole = len(found), b"".join(found)
    stats = [(5, 0)]
    if n:
        same = sum(a == b for a, b in zip(found, found[1:]))
        stats = [(1, n.bit_length(), int(len(set(found)) / n * 12)), (2, int(same / n * 10)), (3, int(sum(kind(c) == 1 for c in whole) / len(whole) * 12)), (4, int(sum(kind(c) == 3 for c in whole) / len(whole) * 24)), (5, n.bit_length()), (6, int(min(len(whole) / n, 30)))]
    for t in stats:
        out[int(spans.mix(np.array([sum((x + 1) * 131**i for i, x in enumerate(t)) + (1 << 50)], np.uint64))[0]) & room] += 0.5
    return out


def test_quality_scores_against_plain_features(spark, folder, stages):
    docs = stages["quality"][0]
    ratings = quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))
    kinds, w, t = quality.fit(docs, ratings, 5, 0, 1500, 1 << 18, "doc_id", "text", "grade")
    want = Counter()
    for r in docs.collect():
        z = sum(w[i] * v for i, v in _features(r.text).items())
        tails = [1 / (1 + np.exp(-np.clip(z - x, -40, 40))) for x in t]
        want[r.doc_id, tuple(round(float(x), 7) for x in tails), bool(tails[0] >= 0.5), round(float(kinds[0] + sum(x * (b - a) for x, a, b in zip(tails, kinds, kinds[1:]))), 7)] += 1
    got = Counter((r.doc_id, tuple(round(x, 7) for x in r.tails), r.kept, round(r.expected_grade, 7)) for r in quality.score(docs, ratings).collect())
    assert got == want


def test_quality_stage_against_scores(spark, folder, stages):
    docs, _, kept = stages["quality"]
    scores = quality.score(docs, quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    assert Counter(r.doc_id for r in scores if r.kept) == Counter(r.doc_id for r in kept)
    plain = [r for r in docs.select("doc_id").collect() if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 4]
    ids = Counter(r.doc_id for r in kept)
    assert np.mean([(ids[r.doc_id] > 0) == (r.doc_id % 6 != 0) for r in plain]) > 0.97


def _many(spark, n=4500):
    """(documents, ratings): more rows of each grade and language than a bounded sample held."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(LANGUAGES["de" if i % 3 else "fr"].split()) + rnd.choice(["", "e", "s"]) for _ in range(rnd.randint(3, 12))), "de" if i % 3 else "fr") for i in range(n)]
    rated = [(i, int(rnd.random() < (0.2 if "katze" in text else 0.7))) for i, text, _ in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6), spark.createDataFrame(rated, "doc_id bigint, grade int")


def test_quality_learns_from_every_rated_row(spark, monkeypatch):
    """Scores against a model of all rows outside the held fold, fitted here and by sums over tasks."""
    docs, ratings = _many(spark)
    grade = {r.doc_id: r.grade for r in ratings.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    taught = [i for i in sorted(grade) if __import__("zlib").crc32(str(i).encode()) % 5 != 0]
    feats = {i: (np.array(list(f), np.int64), np.array(list(f.values()))) for i, f in ((i, _features(x)) for i, x in texts.items())}
    w, t = quality.train([feats[i] for i in taught], np.array([grade[i] for i in taught]), np.ones(len(taught)), 2)
    want = {i: 1 / (1 + np.exp(-(float(w[f[0]] @ f[1]) - t[0]))) for i, f in feats.items()}
    for few, task in ((0, 10_000), (1 << 20, 1 << 22)):
        monkeypatch.setattr(quality, "FEW", few, raising=False)
        monkeypatch.setattr(quality, "TASK", task, raising=False)
        got = {r.doc_id: r.tails[0] for r in quality.score(docs, ratings).collect()}
        assert max(abs(got[i] - want[i]) for i in want) < 1e-4 and len(got) == 4500


def test_language_limits_of_every_training_row(spark):
    """The limit against the plain mean and deviation of the distances of all training rows."""
    docs, _ = _many(spark)
    hold = lambda ids: np.array([i % 7 == 0 for i in ids], bool)
    learnt = langid._table(langid.profiles(docs, hold, 300, "doc_id", "text", "lang"), 300)
    examples = __import__("inspect").signature(langid.keep).parameters["examples"].default
    got = langid.limits(docs, learnt, hold, examples, 2.0, 0.0, 1.0, 300, "doc_id", "text", "lang")
    far = defaultdict(list)
    for r in docs.collect():
        if not hold([r.doc_id])[0]:
            buf = np.frombuffer(r.text.encode(), np.uint8)
            found = next(langid.counted(buf, np.array([0, len(buf)])))
            far[r.lang].append(langid.judged(*found, *learnt, 300)[3][learnt[0].index(r.lang)])
    assert sorted(got) == ["de", "fr"] and all(abs(got[x] - np.mean(far[x]) - 2 * np.std(far[x])) < 1e-9 for x in got)


def test_near_duplicates_against_brute_force(stages):
    docs, _, kept = stages["near_duplicates"]
    sets = defaultdict(set)
    for r in docs.collect():
        w = [x.translate(LOWER) for x in re.findall("[^\x20\x09-\x0d]+", r.text or "")]
        sets[r.doc_id].add(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = Counter(r.doc_id for r in kept)
    nulls = sum(r.doc_id is None for r in docs.collect())
    assert {i for i in got if i is not None} == {find(i) for i in ids} and all(n == 1 for i, n in got.items() if i is not None) and got[None] == nulls


def _nearest(item, text):
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_decontamination_against_edit_distances(stages):
    docs, _, kept = stages["decontamination"]
    item = PASSAGE.encode()
    want = Counter()
    for r in docs.collect():
        flat = re.sub("[\x20\x09-\x0d]", " ", (r.text or "").translate(LOWER)).encode()
        if len(flat) > 20_000 or _nearest(item, flat) > 0.2 * len(item):
            want[r.doc_id] += 1
    assert Counter(r.doc_id for r in kept) == want
    assert not {i for i in want if i is not None and 2000 <= i < 2010}


def test_tokens_against_the_library(stages):
    import tiktoken

    docs, columns, got = stages["byte_bpe"]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert columns == ["doc_id", "n_tokens", "ids"]
    assert Counter((r.doc_id, r.n_tokens, digest(r.ids)) for r in got) == Counter((r.doc_id, len(t), digest(t)) for r in docs.collect() for t in [own.encode_ordinary(r.text or "")])


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs.limit(0), folder)
        assert got.count() == 0 and (got.columns == docs.columns or name == "byte_bpe"), name


def test_stages_without_labels_or_items(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.good(spark, docs, str(tmp_path)).count() == docs.count() == corpus_pipeline.uncontaminated(spark, docs, str(tmp_path)).count()

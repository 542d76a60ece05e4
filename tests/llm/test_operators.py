"""Each corpus operator against a plain version on small rows: nulls, empty and long texts, ties, copies, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t-\r]+")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [None, "", "   \n\t ", "one", "two words", "a b c", "The quick brown fox jumps over the lazy dog. " * 3, "The quick brown fox jumps over the lazy dog. " * 3, LONG, "é ß 漢字 😀 mail me: ann.b@x.example.com +1 (017) 555-7713", "12\x0b34\x1c56 78\x8590"]


def rows(spark, texts=TEXTS, extra=True):
    data = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), 7.0, "x", True) for i, t in enumerate(texts)]
    # columns named like the operators' own outputs
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, size string, kept boolean")


@pytest.fixture(scope="module")
def docs(spark):
    return rows(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return rows(spark, []).limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_audio(docs, empty):
    from tessera.llm.audio import Extractor, Settings, audio_features, from_tensors, from_wav, segments, tensor_type

    got = by_id(audio_features(docs, keep=["doc_id", "score"]))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        want = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert from_wav(got[i]["media"]) == want and got[i]["n_bytes"] == len(raw) and got[i]["payload_bytes"] == len(want)
        assert got[i]["payload_sha256"] == hashlib.sha256(want).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(want[-64:])
        table = from_tensors(got[i]["tensors"])
        assert table.schema.field("log_mel").type == tensor_type(Settings()) and sum(table["n_frames"].to_pylist()) == got[i]["n_frames"]
    assert got[6]["tensors"] == got[7]["tensors"] and got[0]["media"] == got[1]["media"] and got[3]["score"] == 7.0
    assert audio_features(empty).count() == 0
    assert segments(np.array([0, 2, 0.5, 0.5, -2, 0.5, 3]), 1, -1).tolist() == [[1, 4], [6, 7]]
    # log-mel by the sums themselves
    from tessera.llm.audio import log_mel, mel_bank

    s = Settings()
    wave = np.random.default_rng(2).normal(0, 1, 700).astype(np.float32)
    hann, bank = np.hanning(s.window).astype(np.float32), mel_bank(s)
    got_mel = log_mel(wave, s, hann, bank)
    assert got_mel.shape == (5, s.mels)
    top = s.rate * s.up / s.down / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(top) * k / (s.mels + 1) / 2595) - 1) for k in range(s.mels + 2)]
    for i in range(5):
        frame = [float(wave[i * s.hop + k]) * float(hann[k]) if i * s.hop + k < 700 else 0.0 for k in range(s.window)]
        power = [abs(sum(x * np.exp(-2j * np.pi * k * j / s.window) for k, x in enumerate(frame))) ** 2 for j in range(s.window // 2 + 1)]
        for b in (0, 11, s.mels - 1):
            low, mid, high = edges[b : b + 3]
            weight = lambda f: max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) + 1e-6  # noqa: B023, E731
            assert got_mel[i, b] == pytest.approx(np.log(sum(p * weight(j * 2 * top / s.window) for j, p in enumerate(power)) + 1e-3), abs=1e-3)
    # each output of the resampler is its phase's filter over the inputs around it
    s = Settings()
    e = Extractor(s)
    x = np.sin(np.arange(400) / 9).astype(np.float32)
    from tessera.llm.audio import resample

    y = resample(x, s, e.table)
    ext = np.concatenate([np.full(s.taps, x[0]), x, np.full(s.taps + s.down, x[-1])])
    for n in range(0, len(y), 17):
        first = n * s.down // s.up + s.taps // 2 + 1
        assert abs(float(e.table[n * s.down % s.up] @ ext[first : first + s.taps]) - y[n]) < 1e-4


def test_context_mixing(spark, docs, empty):
    from tessera.llm.mixing_lm import learn, scores

    train = docs.where("doc_id % 2 = 0")
    model = learn(train)
    got = by_id(scores(docs, model))
    words = lambda t: [w.lower() if w.isascii() else w.encode().lower().decode() for w in WORD.findall(t or "")]
    c = Counter(w for i, t in enumerate(TEXTS) if i % 2 == 0 for w in [*words(t), "<end>"])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(TEXTS):
        ws = [*words(t), "<end>"]
        assert got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(c[w] > 0 for w in ws) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert got[i]["score"] < 0
    assert got[6]["score"] == got[7]["score"] and got[0]["score"] == got[1]["score"]
    assert scores(empty, model).count() == 0
    none = learn(empty)
    assert by_id(scores(docs, none))[5]["score"] <= 0


def test_context_mixing_probabilities_sum_to_one(spark):
    """All next words together, the unseen one included, have probability 1, and so have all spellings of one byte or none."""
    from tessera.llm import mixing_lm as lm
    from tessera.llm.neardup import WordHashes

    d = spark.createDataFrame([("a b a b a c",), ("a c a b",), ("d",)] * 4, "text string")
    m = lm.learn(d)
    mixer, known = lm.Mixer(m.code, m.tables), WordHashes()
    said = lambda ws, hs: tuple(x[0] for x in mixer.logs(lm.lay(m.code, [ws], [np.array(hs, np.uint64)])))
    total = sum(np.exp(said([w], [known[w]])[0]) for w in (b"a", b"b", b"c", b"d", b"never")) + np.exp(said([], [lm.END])[0])
    assert total == pytest.approx(1, abs=1e-4)
    # a first byte, then anything: the spellings of one byte and of the empty word, with what goes on left out
    stop = m.code.length[len(m.code.hashes) + 1 + lm.STOP]
    assert stop > 0 and said([b"never"], [known[b"never"]])[1] < said([b"n"], [known[b"n"]])[1] < 0


def test_context_mixing_against_one_bit_at_a_time(spark, docs):
    from tessera.llm import mixing_lm as lm
    from tessera.llm.neardup import WordHashes

    m = lm.learn(docs.where("doc_id % 2 = 0"))
    code, mixer = m.code, lm.Mixer(m.code, m.tables)
    raws = [(t or "").encode() for t in TEXTS if t != LONG] + [LONG[:9000].encode(), b"new words here " * 40]
    words, hashes = lm.hashed(raws, WordHashes())
    got = mixer.logs(lm.lay(code, words, hashes))
    one = lambda x: np.array([x], np.uint32)
    where = {int(h): int(s) for h, s in zip(code.hashes, code.symbols, strict=True)}
    shift = np.uint32(32 - code.bits)
    for t, (ws, hs) in enumerate(zip(words, hashes, strict=True)):
        w, fine, sums = mixer.start.astype(float).copy(), np.zeros((2, lm.BOXES)), [0.0, 0.0]
        at, step = 0, lm.FIRST
        while at < len(hs):
            grads, refined = np.zeros_like(w), np.zeros_like(fine)
            for i in range(at, min(len(hs), at + step)):
                b1, b2 = (int(hs[i - 1]) if i > 0 else 1), (int(hs[i - 2]) if i > 1 else 2)
                c1 = lm.scrambled(one((b1 ^ b1 >> 32) & 0xFFFFFFFF))
                todo = [(0, where.get(int(hs[i]), len(code.hashes)), c1, lm.scrambled(c1 * lm.MIX2 + one((b2 ^ b2 >> 32) & 0xFFFFFFFF)))]
                if int(hs[i]) not in where:
                    raw = ws[i] + b"\n"
                    for k, c in enumerate(raw):
                        p = [raw[k - j] if k >= j else 0 for j in (1, 2, 3, 4)]
                        d1 = lm.scrambled(one(p[0] | p[1] << 8 | 1 << 24) * lm.MIX2)
                        todo.append((1, len(code.hashes) + 1 + c, d1, lm.scrambled(d1 * lm.MIX2 + one(p[2] | p[3] << 8 | 1 << 25))))
                for half, symbol, x1, x2 in todo:
                    for place in range(code.begin[symbol], code.begin[symbol] + code.length[symbol]):
                        node, bit = code.key[place : place + 1] >> np.uint32(1), int(code.key[place]) & 1
                        v = [int(m.tables[0][((x1 + node) * lm.MIX1 >> shift)[0]]), int(m.tables[1][((x2 ^ node) * lm.MIX2 >> shift)[0]])]
                        g = half * lm.GATES + (v[0] & 3) * 4 + (v[1] & 3)
                        x = np.array([code.own[place], (v[0] >> 2) / 64, (v[1] >> 2) / 64])
                        st = np.clip(np.float32(w[:, g] @ x), -9, 9)
                        box = int(st * 2 + 18.5)
                        p1 = 1 / (1 + np.exp(-float(st + fine[half, box])))
                        sums[half] += np.log(p1 if bit else 1 - p1)
                        grads[:, g] += (bit - p1) * x
                        refined[half, box] += bit - p1
            w += np.clip(mixer.rate * grads, -0.2, 0.2)
            fine += np.clip(mixer.refine * refined, -0.2, 0.2)
            at, step = at + step, min(lm.MOST, 2 * step)
        assert sums == pytest.approx([got[0][t], got[1][t]], rel=2e-3, abs=2e-3)


def test_context_mixing_finds_words_of_a_part_at_once():
    """Words, hashes and places in the code are those of one word at a time, in less than half its CPU time; log_more is log1p."""
    import time

    from tessera.llm import mixing_lm as lm
    from tessera.llm.neardup import WordHashes

    r = random.Random(4)
    letters = [x for x in range(256) if x not in b"\t\n\x0b\x0c\r "]
    raws = [b"", b" \n", *(b" \t\x0b\x0c\r\n"[i % 6 : i % 6 + 1].join(bytes(r.choices(letters, k=r.choice([1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(i)) for i in range(90)), b"Mail  AB\n"]
    words, hashes = lm.hashed(raws, WordHashes())
    known = WordHashes()
    assert list(words) == [x.lower().split() for x in raws]
    assert [h.tolist() for h in hashes] == [[*(known[w] for w in x.lower().split()), 0] for x in raws]
    counted = lm.summed(np.concatenate(hashes), np.ones(sum(map(len, hashes)), np.int64))
    assert dict(zip(*map(np.ndarray.tolist, counted), strict=True)) == Counter(np.concatenate(hashes).tolist())
    for n in (1, 2, 3, 1000):
        some = counted[0][r.sample(range(len(counted[0])), n)]
        code = lm.Code.of(some, np.ones(n), 3.0, np.ones(256))
        asked = np.append(counted[0], np.array([0, 2**64 - 1], np.uint64))
        at, hit = code.find(asked)
        assert (hit == np.isin(asked, some)).all() and (code.hashes[at[hit]] == asked[hit]).all() and hit.sum() == n
    x = np.exp(np.linspace(-12, 12, 5000)).astype(np.float32)
    assert lm.log_more(x) == pytest.approx(np.log1p(x.astype(float)), rel=5e-7)

    text = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40_000)).encode()] * 2
    took = {}
    for name, run in (("part", lambda k: lm.hashed(text, k)), ("word", lambda k: [np.fromiter(map(k.__getitem__, t.lower().split()), np.uint64) for t in text])) * 5:
        began, known = time.process_time(), WordHashes()
        run(known)
        took[name] = min(took.get(name, 9e9), time.process_time() - began)
    assert took["part"] < 0.5 * took["word"]


def test_convnet(spark, docs, empty):
    from tessera.llm import convnet as cn

    r = random.Random(3)
    good = [" ".join(r.choice(["stone", "river", "green", "walks", "under"]) for _ in range(r.randint(5, 200))) for _ in range(60)]
    bad = [" ".join(r.choice(["stone$$$", "river###", "green%%%"]) for _ in range(r.randint(5, 200))) for _ in range(60)]
    net = cn.fit([x.encode() for x in good[:40] + bad[:40]], [1] * 40 + [0] * 40, {0: 40.0, 1: 40.0})
    s = net.scores([x.encode() for x in good[40:] + bad[40:]])
    assert (s[:20] > 0.5).mean() > 0.9 and (s[20:] < 0.5).mean() > 0.9
    got = by_id(cn.quality_scores(docs, net))
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[6]["score"] == got[7]["score"] and got[0]["score"] == got[1]["score"]
    assert cn.quality_scores(empty, net).count() == 0
    # junk at the very end of a long text counts: chunks cover the whole
    long = " ".join(good[:30])
    assert net.scores([(long + " $$$###%%%" * 200).encode()])[0] < net.scores([long.encode()])[0]
    assert cn.chunks(b"x" * 5000)[-1].tobytes() == b"x" * cn.CHUNK and len(cn.chunks(b"")) == 1
    assert 0 < cn.fit([b"a"], [1], {1: 1.0}).scores([b"q"])[0] < 1
    # a plain convolution: every filter at every place of every chunk
    raw = (" ".join(good[:3]) + "é漢")[:1400].encode()
    z = np.zeros((0, cn.FILTERS))
    for k in sorted({*range(0, max(1, len(raw) - cn.CHUNK), cn.STEP), max(0, len(raw) - cn.CHUNK)}):
        c = (raw[k : k + cn.CHUNK] + bytes(cn.CHUNK))[: cn.CHUNK]
        places = [np.concatenate([net.embed[b] for b in c[i : i + cn.WIDTH]]) @ net.filters + net.bias for i in range(0, cn.CHUNK - cn.WIDTH + 1, cn.STRIDE)]
        z = np.vstack([z, np.maximum(0, np.max(places, 0))])
    logit = np.tanh(np.concatenate([z.mean(0), z.max(0)]) @ net.hidden + net.hidden_bias) @ net.out + net.out_bias[0]
    assert net.scores([raw])[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)
    assert len(cn.spread(b"x" * 10**6)) == cn.FIT_CHUNKS and (cn.spread(raw) == cn.chunks(raw)).all()


def plain_measures(t):
    words = WORD.findall(t or "")
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(wins)
    rep = {j for i, w in enumerate(wins) if c[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)


def test_quality_rules(spark, docs, empty):
    from tessera.llm.weakrules import fit, keep_good, measured, rule_report

    got = by_id(rule_report(docs))
    for i, t in enumerate(TEXTS):
        g = got[i]
        want = plain_measures(t)
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g["kept"] and g["base_failed"])
    assert rule_report(empty).count() == 0 and keep_good(docs).columns == docs.columns
    r = random.Random(5)
    good = [". ".join(" ".join(r.choice(["the", "stone", "river", "of", "green", "walks"]) + str(r.randint(0, 99)) * (r.random() < 0.1) for _ in range(12)) for _ in range(8)) + "." for _ in range(80)]
    bad = [" | ".join(r.choice(["stones", "rivers", "greens"]) + str(i) for i in range(90)) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    kept = {x["doc_id"]: x["kept"] for x in rule_report(d).collect()}
    assert not any(kept[i] for i in range(80, 100)) and sum(kept[i] for i in range(80)) >= 76
    accuracy = fit(measured(d)).accuracy()
    assert all(0 <= x <= 1 for x in accuracy.values())


def test_quality_em_against_one_document_at_a_time(spark):
    from tessera.llm.weakrules import RULES, fit

    r = random.Random(9)
    rows_ = [[r.choices((0, 1, 2), (2, 7, 1) if i % 5 else (1, 4, 5))[0] for _ in RULES] for i in range(300)]
    d = spark.createDataFrame([(50, sum(v * 3**i for i, v in enumerate(x))) for x in rows_], "n_words long, votes long")
    got = fit(d, rounds=5)
    start = {True: [0.18, 0.8, 0.02], False: [0.1, 0.6, 0.3]}
    says = {k: [list(v) for _ in RULES] for k, v in start.items()}
    prior = 0.85
    for _ in range(5):
        sums = {k: [[20.0 * x for x in v] for _ in RULES] for k, v in start.items()}
        good = 0.0
        for x in rows_:
            a, b = prior, 1 - prior
            for i, v in enumerate(x):
                if v:
                    a, b = a * says[True][i][v], b * says[False][i][v]
            q = a / (a + b)
            good += q
            for i, v in enumerate(x):
                sums[True][i][v] += q
                sums[False][i][v] += 1 - q
        says = {k: [[c / sum(row) for c in row] for row in v] for k, v in sums.items()}
        prior = (good + 0.85 * 20) / (len(rows_) + 20)
    assert got.prior == pytest.approx(prior) and np.allclose(got.given_good, says[True]) and np.allclose(got.given_bad, says[False])


def test_quality_verdict_is_the_likelier_class(spark):
    from tessera.llm.weakrules import BAD, GOOD, RULES, Supervisor, judged

    model = Supervisor(0.85, np.tile([0.18, 0.8, 0.02], (len(RULES), 1)), np.tile([0.1, 0.6, 0.3], (len(RULES), 1)))
    # two defects beside three good votes: bad at odds of 17 to 1; one defect beside four: good
    votes = [sum(v * 3**i for i, v in enumerate(x)) for x in ((BAD, BAD, GOOD, GOOD, GOOD), (BAD, GOOD, GOOD, GOOD, GOOD))]
    d = spark.createDataFrame([(i, 100, 0, v) for i, v in enumerate(votes)], "doc_id long, n_words long, n_repeat_words long, votes long")
    got = by_id(judged(d, model))
    assert got[0]["p_good"] == pytest.approx(0.0563, abs=1e-4) and not got[0]["kept"]
    assert got[1]["p_good"] > 0.5 and got[1]["kept"]


def plain_components(texts, words, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").encode().lower().decode())
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    low = list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates(spark, docs, empty):
    from tessera.llm.neardup import drop_near_duplicates, near_duplicates

    r = random.Random(1)
    base = [[r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) + str(r.randint(0, 50)) for _ in range(r.choice([8, 40, 120]))] for _ in range(12)]
    texts = list(TEXTS)
    for b in base:
        for _ in range(r.choice([2, 5, 14])):
            w = list(b)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = "new" + str(r.randint(0, 9))
            texts.append(" ".join(w))
    d = rows(spark, texts).repartition(5)
    for words, percent in ((3, 85), (5, 80)):
        want, sizes = plain_components(texts, words, percent)
        got = by_id(near_duplicates(d, words, percent))
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert all(got[i]["kept"] == (want[i] == i) for i in got)
    assert drop_near_duplicates(d.unionByName(d), 5, 80).count() == len(set(want)) and near_duplicates(empty).count() == 0


def test_near_duplicates_beside_a_hub(spark, monkeypatch):
    """Clusters that share buckets with a hub but aren't linked with it: pairs grow with the members, and no link is lost."""
    from tessera.llm import neardup as nd

    made, verified = [], nd.verified
    monkeypatch.setattr(nd, "verified", lambda pairs, *rest: (made.append(pairs.count()), verified(pairs, *rest))[1])
    r = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    n, texts = 300, []
    for far in range(3):
        words = list(base)
        for k in range(6 * min(far, 1)):
            words[5 + 19 * k + far] = f"far{far}x{k}"
        for i in range(n):
            own = list(words)
            own[r.randrange(120)] = f"own{far}x{i}"
            texts.append(" ".join(own))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = [x["component_id"] for x in sorted(nd.near_duplicates(d, 3, 85).collect(), key=lambda x: x["doc_id"])]
    assert got == [i // n * n for i in range(3 * n)]
    # all pairs of the two clusters beside the hub would be 90,000
    assert sum(made) < 20 * len(texts), made


def test_form_letters_are_compared_in_few_rounds(spark, monkeypatch):
    """Texts that differ in eight places, each with one of four words: most pairs meet in buckets, and one in forty is linked."""
    from tessera.llm import neardup

    r, n = random.Random(4), 70
    texts = []
    for _ in range(n):
        words = [f"w{i}" for i in range(120)]
        for place in range(8):
            words[7 + 14 * place] = f"v{place}x{r.randrange(4)}"
        texts.append(" ".join(words))
    pairs, rounds = [], []
    compare, following = neardup.verified, neardup.next_pairs
    monkeypatch.setattr(neardup, "verified", lambda some, *rest: pairs.append(some.count()) or compare(some, *rest))
    monkeypatch.setattr(neardup, "next_pairs", lambda *rest: rounds.append(1) or following(*rest))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(d, 3, 85).collect()}
    assert [got[i] for i in range(n)] == plain_components(texts, 3, 85)[0]
    assert sum(pairs) <= 25 * n and len(rounds) <= 6


def test_near_duplicates_repeated_ids(spark):
    from tessera.llm.neardup import drop_near_duplicates, near_duplicates

    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    data = [(5, long, "a"), (5, other, "b"), (5, long, "a"), (6, long, "c"), (7, other, "d"), (None, long, "e"), (8, None, "f"), (9, "", "g")]
    d = spark.createDataFrame(data, "doc_id long, text string, row_ string")
    got = near_duplicates(d)
    assert got.count() == len(data) and got.where("doc_id = 5").distinct().count() == 1
    kept = drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted(x["row_"] for x in kept.collect() if x["doc_id"] != 5) in (["d", "e", "f", "g"], ["c", "e", "f", "g"])
    assert kept.where("doc_id = 5").count() == 1


def test_maybe_in_misses_no_key(spark, monkeypatch):
    from tessera.llm import common

    r = random.Random(3)
    d = spark.createDataFrame([(r.getrandbits(62), i % 3) for i in range(4000)], "a long, b long")
    d = d.unionByName(spark.createDataFrame([(None, 1)], "a long, b long"))
    for bits in (1 << 26, 1 << 17):
        monkeypatch.setattr(common, "BITS", bits)
        got = common.maybe_in(d, d.where("b = 0"), ["a", "b"])
        assert got.columns == ["a", "b", "maybe"] and got.count() == 4001 and got.where("b = 0 and not maybe").count() == 0
        assert got.where("b > 0 and maybe").count() < 400
    assert common.maybe_in(d, d.where("b > 5"), ["a"]).where("maybe").count() == 0


@pytest.mark.parametrize("name", ["near_duplicates", "drop_near_duplicates"])
def test_near_duplicates_move_few_texts(spark, tmp_path, name):
    """Texts without a near one aren't shuffled, and shuffle files and tables of the rounds don't stay."""
    import glob
    import os

    from tessera.llm import neardup
    from tessera.llm.common import shared_root

    r = random.Random(6)
    texts = [" ".join(f"{r.getrandbits(60):x}" for _ in range(1500)) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate([*texts, texts[7] + " more", texts[9]])), "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/in")
    root = shared_root(spark).removeprefix("file://")
    shared = lambda: set(glob.glob(f"{root}/tessera/*"))
    shuffled = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))
    before, tables = shuffled(), shared()
    getattr(neardup, name)(spark.read.parquet(f"{tmp_path}/in")).write.parquet(f"{tmp_path}/out")
    assert {x["doc_id"] for x in spark.read.parquet(f"{tmp_path}/out").collect() if x.asDict().get("kept", True)} == set(range(200))
    left = sum(os.path.getsize(x) for x in shuffled() - before)
    assert left < 0.1 * sum(map(len, texts)), left
    assert not [x for x in shared() - tables if os.path.basename(x).split("-")[0] in ("texts", "compared", "classes")]


def test_super_minhash_estimates_and_parts():
    from tessera.llm import neardup as nd

    g = np.random.default_rng(2)
    a = np.unique(g.integers(0, 2**63, 900).astype(np.uint64))
    b = np.concatenate([a[:600], np.unique(g.integers(0, 2**63, 300).astype(np.uint64))])
    s = nd.super_minhash([a, b], 190)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12
    whole, nd.TOGETHER = nd.TOGETHER, 100
    try:
        assert (nd.super_minhash([a, b], 190) == s).all()
    finally:
        nd.TOGETHER = whole


def test_language(spark, docs, empty):
    from tessera.llm.langid import dictionaries, identify

    r = random.Random(4)
    en, fr = "the stone walks under green rivers with great lights".split(), "une pierre marche sous les rivieres vertes avec lumieres".split()
    text = lambda ws: " ".join(r.choice(ws) for _ in range(r.randint(8, 60)))
    d = spark.createDataFrame([(i, text(en if i % 2 else fr), "en" if i % 2 else "fr") for i in range(200)] + [(200, "x", None), (201, None, "de")], "doc_id long, text string, lang string")
    content = dictionaries(d.where("doc_id < 100 or doc_id >= 200"))
    assert sorted(content) == ["en", "fr"]
    got = identify(d.where("doc_id between 100 and 199"), content).collect()
    assert sum(x["lang_pred"] == x["lang"] for x in got) >= 95 and all(0 <= x["score"] <= 1 for x in got)
    # the smallest code of the whole text, one dictionary after the other
    import zstandard as z

    from tessera.llm.langid import LEVEL, Classifier, letters

    model, how = Classifier(content), z.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    for x in [text(en + fr) for _ in range(60)]:
        size = {k: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(v, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress(letters(x))) for k, v in content.items()}
        name, _, margin, rejected = model.guess(x)
        assert size[name] == min(size.values()) and margin == (max(size.values()) - size[name]) / max(size.values()) and rejected == (margin < 0.01)
    # codes of two words are as long in both; their endings tell
    assert model.guess("sous lumieres")[0] == "fr" and model.guess("great lights")[0] == "en"
    # a long text counts from anywhere, not from its beginning
    late = spark.createDataFrame([(i, "zzz " * 3000 + text(fr) * 400, "fr") for i in range(30)], "doc_id long, text string, lang string")
    assert b"pierre" in dictionaries(late)["fr"]
    out = by_id(identify(docs, content))
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[2]["lang_pred"] == "und" and out[6]["lang_pred"] == out[7]["lang_pred"]
    assert identify(empty, content).count() == 0 and {x["lang_pred"] for x in identify(docs, {}).collect()} == {"und"}


def test_source_mix(spark, docs, empty):
    from tessera.llm.sourcemix import mix, take_mix

    got = mix(docs).collect()
    size = {r["doc_id"]: r["size"] for r in got}
    assert all(size[i] == len(WORD.findall(t or "")) for i, t in enumerate(TEXTS))
    total, per = sum(size.values()), {}
    for i in range(len(TEXTS)):
        per.setdefault(f"s{i % 3}" if i % 4 else None, []).append(i)
    names = sorted((k for k in per if k), key=str) + ([None] if None in per else [])
    w = {k: (1, 2, 3)[n % 3] for n, k in enumerate(names)}
    most = {k: 3 * sum(size[i] for i in per[k]) for k in names}
    target, left, free = {}, float(total), list(names)
    while free:
        level = left / sum(w[k] for k in free)
        over = [k for k in free if level * w[k] >= most[k]]
        if not over:
            target |= {k: level * w[k] for k in free}
            break
        for k in over:
            target[k] = float(most[k])
            left -= most[k]
        free = [k for k in free if k not in over]
    for k in names:
        mine = [r for r in got if r["doc_id"] in per[k]]
        assert all(r["target"] == pytest.approx(target[k]) for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(int(target[k] + 1e-9), abs=1)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        if (n := sum(size[i] for i in per[k])) and (full := int(target[k] // n)):
            assert all(r["taken"] >= full * r["size"] for r in mine)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs).collect())) and mix(empty).count() == 0
    taken = take_mix(docs)
    assert taken.columns == docs.columns and sum(len(WORD.findall(r["text"])) for r in taken.collect()) == sum(r["taken"] for r in got)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    d = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        n = [int(c) for c in s[::-1]]
        return (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(d(m.group())) <= 19 and luhn(d(m.group()))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(d(m.group())) <= 15])


def test_personal_data(spark, docs, empty):
    from tessera.llm.pii import fit, fitted, patterns, personal_data

    r = random.Random(6)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "79927398713", "+1 (017) 555-7713", "+12", "+", "word", ".", " ", "-", "1", "a@b.c@d.e", "0001.2.3.4"]
    for _ in range(3000):
        t = "".join(r.choice(bits) + r.choice(["", " ", "."]) for _ in range(r.randint(1, 9)))
        assert sorted((a, k, b) for a, b, k in patterns(t)) == plain_spans(t), t
    p = fitted(docs)
    got = by_id(personal_data(docs, p))
    for i, t in enumerate(TEXTS):
        base = [(s["start"], s["kind"], s["end"]) for s in got[i]["pii"] if s["pattern"]]
        assert base == [(a, ("email", "ip", "card", "phone")[k], b) for a, k, b in plain_spans(t or "")]
        assert (got[i]["redacted"] is None) == (t is None)
    assert "<email>" in got[9]["redacted"] and "555" not in got[9]["redacted"] and personal_data(empty, p).count() == 0
    assert patterns("a" * 200_000 + " " + "1" * 200_000 + "@") == []
    # a card that a pattern misses beside another number is found by its second mention
    from tessera.llm.pii import find

    train = [f"pay with {n} or {n} now" for n in ("4111111111111111", "5500005555555559", "4012888888881881")] * 20
    base, added = find("see 4111111111111111 4550997810720808 and later 4111111111111111 here", fit(train))
    assert [s[2] for s in base] == [2] and (4, 20, 2) in added
    assert find("version 2.0 of 15 parts, 2024", fit(train)) == ([], [])


def test_personal_data_written_otherwise():
    from tessera.llm.pii import find, fit, graph, patterns

    train = [f"pay with {n} or {n} now, call +{c} or {c}" for n in ("4111111111111111", "5500005555555559", "4012888888881881") for c in ("1 555 010 7713", "44 555 019 2231")] * 20
    p = fit(train)
    for text, want in (
        ("call +1 555 123 4567, later 555-123-4567 or 15551234567", ["555-123-4567", "15551234567"]),
        ("call +15551234567, later 555 123 4567 or (555) 123-4567", ["555 123 4567", "(555) 123-4567"]),
        ("card 4111111111111111 and 4111 1111 1111 1111 4550 9978 here", ["4111 1111 1111 1111"]),
    ):
        base, added = find(text, p)
        assert [text[a:b] for a, b, _ in added if not any(a < y and x < b for x, y, _ in base)] == want, text
    linked = lambda t: {tuple(sorted((g.spans[i], g.spans[j]))) for i, j, s in g.edges.tolist() if s} if (g := graph(t, patterns(t))) else set()
    assert linked("555 123 4567 then 555 123 4567") == {((0, 12), (18, 30))}
    # nothing is linked with a part of itself, and a table of small numbers is no number
    assert linked("1 555 123 4567") == set() and linked("12 34 56 78 90 and 11 22 33 44 55") == set()
    assert find("rows 12 34 56 78 90 and 11 22 33 44 55", p) == ([], [])
    assert len(find("1 " * 100_000, p)[0]) == 0


def test_personal_data_messages_against_all_labellings():
    from itertools import product

    from tessera.llm.pii import FEATURES, LABELS, Graph, Potentials, beliefs, find, fit, graph, patterns

    g = np.random.default_rng(4)
    p = Potentials(g.normal(0, 1, (FEATURES, LABELS)), g.normal(0, 0.5, (2, LABELS, LABELS)))
    p.pair = (p.pair + p.pair.transpose(0, 2, 1)) / 2
    for edges, near in (([(0, 1, 0), (1, 2, 1), (1, 3, 1)], 1e-3), ([(0, 1, 0), (1, 2, 0), (0, 2, 1), (2, 3, 1)], 0.08)):
        on = (g.random((4, FEATURES)) < 0.2).astype(np.float32)
        known = np.array([-1, -1, 2, -1])
        field = Graph([(k, k + 1) for k in range(4)], on, known, np.array(edges), np.arange(4), np.zeros(4, bool))
        want = np.zeros((4, LABELS))
        for y in product(range(LABELS), repeat=4):
            if y[2] == 2:
                weight = np.exp(sum(on[i] @ p.unary[:, y[i]] for i in range(4)) + sum(p.pair[s][y[a], y[b]] for a, b, s in edges))
                for i in range(4):
                    want[i, y[i]] += weight
        assert abs(beliefs(field, p) - want / want.sum(1, keepdims=True)).max() < near
    # similar tokens: one digit changed, or the mailbox elsewhere
    linked = lambda t: {(a, b) for a, b, s in graph(t, patterns(t)).edges.tolist() if s}
    assert linked("4111111111111111 or 4111111111111121") == {(0, 1)} and linked("ann.lee@x.example.com or ann.lee@host") == {(0, 1)}
    assert linked("4111111111111111 or 4111111111112221") == set() and linked("a@x.example.com or a@host") == set()
    train = [f"pay with {n} or {n} now, ask {m}@a.example.com or {m}@a.example.com" for n in ("4111111111111111", "5500005555555559", "4012888888881881") for m in ("ann.lee", "bo.li", "cy.ng")] * 20
    base, added = find("pay with 4111111111111111 now, then 4111111111111121 again", fit(train))
    assert [s[2] for s in base] == [2] and (36, 52, 2) in added


def test_stages_keep_columns_and_odd_rows(spark, docs, empty):
    """Every stage over nulls, empty and long texts, repeated rows and columns named like its own, in any case."""
    import corpus_pipeline as p

    names = ["N_WORDS", "votes", "kept", "P_Good", "pii", "redacted", "row_", "key", "at", "same", "bands", "size_", "id_", "text_"]
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names])
    odd = odd.unionByName(odd.where("doc_id in (0, 6, 8)")).unionByName(odd.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).cache()
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.schema.simpleString() == odd.schema.simpleString(), name
        found = got.collect()
        assert all(r[n] == f"{n}:{r['doc_id'] if r['doc_id'] is not None else 4}" for r in found for n in names), name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        if name == "personal_data":
            assert len(found) == odd.count() and [r["text"] for r in found if r["doc_id"] == 0] == [None, None]
        if name == "near_dedup":
            assert sorted(str(r["doc_id"]) for r in found) == sorted(["None", *(str(i) for i in range(len(TEXTS)) if i != 7)])
        if name == "quality_rules":
            assert {r["doc_id"] for r in found} <= {8} and len(found) in (0, 2)
    assert p.STAGES[-1][1](spark, odd, SF).where("doc_id = 0").count() == 2 and p.STAGES[-1][1](spark, odd.limit(0), SF).count() == 0


def test_tokens_and_files(spark, docs, empty):
    from tokenizers import Tokenizer

    from tessera.llm.tokens import Encoder, pack, pack_shard, read_ids, token_table, unpack, vocabulary_file

    r = random.Random(8)
    odd = ["", "  ", " a", "a  b\n \n c  ", "don't  'll it's\x1c foo\x85bar　 baz", "é éx ΑΣ ΑΣ.", "<|endoftext|> hi", "\n\n a\t b", "İstanbul ǅ ﬁ 12345 ½ 😀😀 ok", "   x", "x. \n\ty", "Ünïcode ñ"]
    odd += ["".join(r.choice(" \n\tabcé.,'1²$İ字") for _ in range(r.randint(1, 30))) for _ in range(400)]
    for name, spaces in (("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")):
        e, t = Encoder(vocabulary_file(name), spaces), Tokenizer.from_file(vocabulary_file(name))
        for x, ids in zip(odd, e.encode(odd), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
    g = np.random.default_rng(0)
    for bits in (1, 5, 13, 16, 17, 20):
        ids = g.integers(0, 2**bits, 3000).astype(np.uint32)
        assert (unpack(pack(ids, bits), len(ids), bits) == ids).all() and len(pack(ids, bits)) == -(-3000 * bits // 8)
        payload, index = pack_shard(ids, bits)
        for a, b in ((0, 3000), (1000, 1100), (2047, 2049), (2999, 3000), (5, 5)):
            assert (read_ids(payload, index, a, b, bits) == ids[a:b]).all()
    t = Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))
    got, start = by_id(token_table(docs, vocabulary_file("word_bpe_49k.json"))), 0
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_table(empty, vocabulary_file("word_bpe_49k.json")).count() == 0


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    from tessera.llm.binpack import best_fit, pack_documents
    from tessera.llm.tokens import vocabulary_file

    path = vocabulary_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    many = docs.unionByName(docs.where("doc_id between 3 and 9").withColumn("doc_id", F.col("doc_id") + 100)).repartition(20)
    got = pack_documents(many, path).collect()
    bins, pieces = {}, {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    for r in many.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[r["doc_id"]], key=lambda p: p["piece"])
        assert [p["piece"] for p in own] == list(range(len(own))) and sum(p["length"] for p in own) == len(ids) and len(own) == -(-len(ids) // 1024)
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    tokens = sum(r["length"] for r in got)
    assert len(bins) <= -(-tokens // 1024) + 2 and pack_documents(empty, path).count() == 0
    place, at, fill = best_fit(np.array([600, 400, 424, 1024, 1, 623]), 1024)
    # 1024; 623 with 400 and 1; 600 with 424
    assert fill.tolist() == [1024, 1024, 1024] and place.tolist() == [2, 1, 2, 0, 1, 1] and at.tolist() == [0, 623, 600, 0, 1023, 0]


def test_packing_across_partitions(spark):
    from tessera.llm.binpack import best_fit, best_fit_counts, pack_documents
    from tessera.llm.tokens import vocabulary_file

    g = np.random.default_rng(5)
    for n in (1, 3, 40, 700):
        lengths = g.integers(1, 65, n)
        got = best_fit_counts(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)), 64)
        fill = {}
        for i, (need, first, lo, each, at) in enumerate(got.tolist()):
            last = got[i + 1, 1] if i + 1 < len(got) and got[i + 1, 0] == need else (lengths == need).sum()
            for k in range(last - first):
                fill.setdefault(lo + k // each, []).append((at + k % each * need, need))
        for b in fill.values():
            b.sort()
            assert [a for a, _ in b] == np.cumsum([0, *(x for _, x in b)])[:-1].tolist() and sum(x for _, x in b) <= 64
        assert sorted(x for b in fill.values() for _, x in b) == sorted(lengths.tolist()) and len(fill) == len(best_fit(lengths, 64)[2])
    # each long text of one partition has room for a short one of another, however many there are
    texts = spark.range(12_000, numPartitions=2).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, F.repeat(F.lit(" a"), 599)).otherwise(F.repeat(F.lit(" a"), 399)).alias("text"))
    got = pack_documents(texts, vocabulary_file("byte_bpe_50k.json")).cache()
    assert got.agg(F.min("length"), F.max("length"), F.count("doc_id")).first()[:] == (400, 600, 12_000)
    bins = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("a"), F.max(F.col("offset") + F.col("length")).alias("b"))
    assert bins.where("n > 1024 or a != 0 or b != n").count() == 0 and bins.count() == 6000


def test_packing_tree_against_a_plain_version(spark, monkeypatch):
    from tessera.llm import binpack
    from tessera.llm.tokens import vocabulary_file

    monkeypatch.setattr(binpack, "FAN", 2)
    # eight leaves, three rounds: (name, fill) of underfull bins, one of each leaf half full or less
    g = np.random.default_rng(11)
    leaves = [[100 * n + i for i in range(4)] for n in range(8)]
    fill = {b: int(x) for leaf in leaves for b, x in zip(leaf, [*g.integers(33, 56, 3), g.integers(3, 20)], strict=True)}
    rows = spark.createDataFrame([(b, b, 0, fill[b], n) for n, leaf in enumerate(leaves) for b in leaf], binpack.BRANCH)
    plain = {n: [(fill[b], [b]) for b in leaf] for n, leaf in enumerate(leaves)}
    merged = 0
    for nodes in (4, 2, 1):
        got = binpack.tree_round(rows.withColumn("node", F.pmod("node", F.lit(nodes))), 64).cache()
        expected = {}
        for n in range(nodes):
            bins = []
            for size, own in sorted((x for m in plain if m % nodes == n for x in plain[m]), key=lambda x: (-x[0], x[1][0])):
                room = [b for b in bins if b[0] + size <= 64]
                if room:
                    best = max(room, key=lambda b: b[0])
                    best[0], best[1], best[2] = best[0] + size, best[1] + own, best[2] + 1
                else:
                    bins.append([size, own, 1])
            expected[n] = sorted(b[0] for b in bins if b[2] > 1)
        roots = {}
        for r in got.collect():
            roots.setdefault((r["node"], r["root"]), []).append(r)
        for own in roots.values():
            at = 0
            for r in sorted(own, key=lambda r: r["base"]):
                assert r["base"] == at
                at += fill[r["bin"]]
            assert {r["fill"] for r in own} == {at} and at <= 64
        assert {n: sorted(own[0]["fill"] for (m, _), own in roots.items() if m == n) for n in range(nodes)} == expected
        merged += len(roots)
        rows = got.where("fill < 56")
        plain = {n: [(own[0]["fill"], [root]) for (m, root), own in roots.items() if m == n and own[0]["fill"] < 56] for n in range(nodes)}
    assert merged > 3
    # whole: all pieces stand once, without gaps, some in sequences of several leaves, in no more sequences than one plan makes
    texts = spark.range(600, numPartitions=8).select(F.col("id").alias("doc_id"), F.repeat(F.lit(" a"), F.pmod(F.xxhash64("id"), F.lit(60)).cast("int") + 1).alias("text"))
    path = vocabulary_file("byte_bpe_50k.json")
    out = binpack.pack_documents(texts, path, 64).cache()
    bins = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("a"), F.max(F.col("offset") + F.col("length")).alias("b"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("at"), F.array_sort(F.collect_set(F.floor(F.col("doc_id") / 75))).alias("leaves"))
    rows = bins.collect()
    for r in rows:
        assert (r["a"], r["b"]) == (0, r["n"]) and r["n"] <= 64
        assert [x["offset"] for x in r["at"]] == np.cumsum([0, *(x["length"] for x in r["at"])])[:-1].tolist()
    assert out.select("doc_id", "piece").distinct().count() == out.count() == 600
    assert sum(len(r["leaves"]) > 1 for r in rows if r["sequence_id"] < binpack.UPPER) > 0
    monkeypatch.setattr(binpack, "tree", lambda placed, size: None)
    assert len(rows) <= binpack.pack_documents(texts, path, 64).select("sequence_id").distinct().count() + 1


def test_pipeline_and_queries(spark):
    import corpus_pipeline as p
    from tessera.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in p.STAGES[:-1]:
        before, at = at, stage(spark, at, SF).cache()
        assert at.columns == docs.columns, name
        assert at.count() <= before.count() or name == "source_mix"
    out = p.STAGES[-1][1](spark, at, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert sorted(QUERIES) == sorted(k for k in QUERIES if re.match(r"op\d+_", k)) and len(QUERIES) == 13
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = QUERIES["op4_quality_rules"](spark, SF).join(labels, "doc_id").where("not base_failed")
    assert kept.where("quality = 1 and not kept").count() <= 0.02 * kept.where("quality = 1").count() + 1

"""Operators against plain Python over a small fixture."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lexloom.llm import exact_dedup, langid, lm_scoring, mixing, packing, quality_classifier, quality_rules, sharding, simhash, toxicity
from lexloom.llm.common import held_out
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    syllables = "ba de ko lu mi né ra so ti ön".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        out.append("\n".join(lines))
    for i in range(40):  # near copies, exact copies, changed case
        base = rng.choice(out[:120]).split(" ")
        if i % 3:
            base[rng.randrange(len(base))] = word()
        out.append(" ".join(base).upper() if i % 3 == 0 else " ".join(base))
    return out + ["", None, " ", "one", "two words", "SHARED LINE\nrest"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(3 * i + 1, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3).cache()


def ids(texts):
    return [3 * i + 1 for i in range(len(texts))]


def test_simhash(docs, texts):
    prints = []
    for t in texts:
        w = WORD.findall(lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r for r in simhash.find_groups(docs).collect()}
    for i, d in enumerate(ids(texts)):
        assert got[d]["fp"] % (1 << 64) == prints[i] and got[d]["component_id"] == 3 * root[i] + 1


def test_covering_masks_miss_no_pair():
    masks, rng = simhash.covering_masks(4, list(range(64))), random.Random(1)
    assert len(masks) == 31
    for _ in range(3000):
        apart = sum(1 << p for p in rng.sample(range(64), 4))
        assert any(not m & apart for m in masks)


def test_links_of_split_buckets(spark):
    rng = random.Random(2)
    center = rng.getrandbits(63)
    fps = sorted({center ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(150)} | {rng.getrandbits(62) for _ in range(50)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")

    def groups(pairs):
        root = {f: f for f in fps}
        for a, b in pairs:
            x, y = root[a], root[b]
            if x != y:
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        return root

    want = groups([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4])
    for size in (20_000, 10):
        got = [(r["a"], r["b"]) for r in simhash.links(nodes, 4, split_size=size).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in got) and groups(got) == want
    from lexloom.llm.common import Scratch

    scratch = Scratch(spark, "test")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 4), scratch).collect()}
    assert all(roots.get(f, f) == want[f] for f in fps)


def test_exact_dedup(docs, texts):
    groups = {}
    for d, t in zip(ids(texts), texts):
        groups.setdefault(lower(t), []).append(d)
    got = {r["doc_id"]: r for r in exact_dedup.find_groups(docs, capacity=5).collect()}
    for t, members in groups.items():
        for d in members:
            assert (got[d]["keep_id"], got[d]["group_size"], got[d]["kept"]) == (max(members), len(members), d == max(members))


def test_exact_dedup_compares_bytes_whatever_the_hash(docs, texts):
    """Other hashes and capacities change buckets and chains, never the groups; texts under one hash get places of one chain."""
    want = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.find_groups(docs).collect()}
    owners = set()
    for hash_of in (F.xxhash64, lambda c: F.pmod(F.length(c), F.lit(3)).cast("long"), lambda c: F.lit(-1).cast("long"), lambda c: F.length(c).cast("long") * 0x0123456789ABCDE):
        for capacity in (None, 2, 1000):
            rows = exact_dedup.find_groups(docs, capacity=capacity, hash_of=hash_of).collect()
            assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows} == want and len(rows) == len(want)
            owners.add(len({r["bucket"] for r in rows}))
            if hash_of is not F.xxhash64:
                chains = Counter()
                for sha, chain in {(r["text_sha256"], r["chain"]) for r in rows if r["bucket"] == rows[0]["bucket"]}:
                    chains[sha] += 1
                assert max(r["chain"] for r in rows) > 0 and set(chains.values()) == {1}
            else:
                assert {r["chain"] for r in rows} == {0}
    assert len(owners) > 2


def test_exact_dedup_owners_hold_whole_key_ranges(spark, docs):
    owners = exact_dedup.owners_of(list(range(9)), [5, 5, 40, 1, 1, 1, 7, 0, 3], 4)
    assert list(owners.values()) == sorted(owners.values()) and set(owners.values()) <= set(range(4))
    keys = exact_dedup.owner_keys(spark, 37)
    assert len(set(keys)) == 37
    parts = spark.createDataFrame([(k,) for k in keys], "owner long").repartition(37, "owner").select("owner", F.spark_partition_id().alias("p")).collect()
    assert {r["owner"]: r["p"] for r in parts} == {k: p for p, k in enumerate(keys)}


def test_exact_dedup_hot_hashes(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(600)] + [(1000 + i, "Same Text") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in exact_dedup.find_groups(docs).collect()}
    assert len(got) == 700 and all((got[d]["keep_id"], got[d]["group_size"]) == ((1099, 500) if t.lower() == "same text" else (d, 1)) for d, t in rows)
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs).collect()) == sorted([d for d, t in rows if t.lower() != "same text"] + [1099])


def test_directory_doubles_only_where_needed():
    depth, slots = exact_dedup.split_buckets({0: 9, 1: 9, 4000: 3}, 10, 12)
    assert depth == 12 and len(slots) == 4096
    assert slots[0][0] != slots[1][0] and slots[2048][1] == 1 and len({b for b, _ in slots}) == 13
    assert exact_dedup.split_buckets({}, 10, 12) == (0, [(0, 0)])


def test_sharding(docs, texts):
    got = sorted(sharding.shard_by_bytes(docs, 8).collect(), key=lambda r: r["doc_id"])
    size = [len((t or "").encode()) + 1 for t in texts]
    assert [r["size"] for r in got] == size and [r["text_crc32"] for r in got] == [zlib.crc32((t or "").encode()) for t in texts]
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    for s in range(8):
        part = [r for r in got if r["shard"] == s]
        assert [r["slot"] for r in part] == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - sum(size) / 8) <= max(size)


def test_shards_by_midpoint(docs, texts):
    """A row's shard is the one in which the middle of its bytes lies, on the line of all rows in order of id."""
    got = {r["doc_id"]: r for r in sharding.shard_by_bytes(docs, 8).collect()}
    size = [len((t or "").encode()) + 1 for t in texts]
    total, before = sum(size), 0
    for d, n in zip(ids(texts), size):
        assert (got[d]["shard"], got[d]["prefix_bytes"]) == (min(7, (2 * before + n) * 8 // (2 * total)), before)
        before += n


def test_mixing(docs, texts):
    size = {d: len(WORD.findall(t or "")) for d, t in zip(ids(texts), texts)}
    source = {d: (f"s{i % 4}" if i % 9 else None) for i, d in enumerate(ids(texts))}
    total = Counter()
    for d in size:
        total[source[d]] += size[d]
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level >= 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * level for s in open_}
    rows = mixing.mix(docs).collect()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]] and math.isclose(r["target"], target[r["source"]])
        rate = target[r["source"]] / total[r["source"]]
        assert r["copies"] in (math.floor(rate), math.ceil(rate)) and r["taken"] == r["copies"] * r["size"]
    emitted = Counter(r["doc_id"] for r in mixing.emit(docs).select("doc_id").collect())
    assert emitted == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_packing(docs, texts):
    got = packing.pack(docs, capacities=(8, 16, 32), group_rows=50).collect()
    bins, whole = {}, {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
        whole.setdefault(r["doc_id"], []).append((r["piece_start"], r["tokens"]))
    for d, t in zip(ids(texts), texts):
        at = 0
        for start, n in sorted(whole[d]):
            assert start == at
            at += n
        assert at == len(WORD.findall(t or "")) + 1
    for rows in bins.values():
        used = sum(r["tokens"] for r in rows)
        assert rows[0]["capacity"] == min(c for c in (8, 16, 32) if c >= used)
        at = 0
        for r in sorted(rows, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["tokens"]
    assert sum(r["tokens"] for r in got) / sum(rows[0]["capacity"] for rows in bins.values()) > 0.9


def plain_best_fit(lengths, capacities, largest, scale):
    """Cost of best fit from long to short by looking at every open bin, and what each bin holds."""
    top, cost = capacities[-1], lambda c: packing.bin_cost(c, scale)
    pieces = sorted((min(top, n - a) for n in lengths for a in range(0, max(n, 1), top)), reverse=True)
    rest, bins = sum(pieces), []  # [capacity opened, contents], in order of the last touch
    for p in pieces:
        open_ = [b for b in bins if b[0] - b[1] >= p]
        if open_:
            least = min(b[0] - b[1] for b in open_)
            best = [b for b in open_ if b[0] - b[1] == least][-1]  # of equal ones the last that was touched
            bins = [b for b in bins if b is not best]
        else:
            fits = [c for c in capacities if c >= p]
            fits = [c for c in fits if c <= largest or c == fits[0]]
            best = [min(fits, key=lambda c: (cost(c) / min(c, rest), c)), 0]
        bins.append(best)
        best[1] += p
        rest -= p
    return sum(cost(min(c for c in capacities if c >= n)) for _, n in bins), sorted(n for _, n in bins)


def test_packing_against_plain_best_fit():
    rng = random.Random(12)
    for _ in range(60):
        lengths = [rng.choice([1, rng.randint(1, 40), rng.randint(1, 9)]) for _ in range(rng.randint(1, 80))]
        capacities = (8, 16, 32)
        want = min((plain_best_fit(lengths, capacities, c, 64) for c in capacities), key=lambda x: x[0])
        rows, contents = packing.pack_lengths(lengths, capacities, 64), {}
        for _, _, n, b, _, _ in rows:
            contents[b] = contents.get(b, 0) + n
        got = sum(packing.bin_cost(c, 64) for c in {b: c for _, _, _, b, c, _ in rows}.values())
        assert math.isclose(got, want[0]) and sorted(contents.values()) == want[1]


def test_quality_rules(spark, docs, texts):
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for d, t in zip(ids(texts), texts):
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        marked = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked))
        assert tuple(got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Shared 12 line\nanother shared line\n{long.replace('w', 'q' * (i % 3 + 1) + str(i))}", "a") for i in range(30)] + [(99, "Shared  99 LINE\nanother shared line\n" + "y", "a"), (100, long + "\nshared 00 line", "b")]
    rows += [(200 + i, (" ".join(f"b{i}" for i in range(60)) + "\n") + f"own{i}", "a") for i in range(30)]
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["removed_lines"] == 2 and got[0]["kept"] and got[100]["removed_lines"] == 0
    assert got[200]["removed_lines"] == 1 and not got[200]["kept"] and not got[200]["base_failed"]


def test_kneser_ney_adds_up():
    words = Counter({"aba": 5, "abc": 2, "ca": 1, "bca": 3})
    model = langid.LanguageModel({"x": words, "y": Counter({"zz": 4, "za": 1})}, order=3)
    kn = langid.KneserNey(words, 3, 6)
    letters = ["a", "b", "c", "\x03", "z", "?"]
    for context in ("", "\x02", "a", "ab", "\x02a", "zz", "qa"):
        assert math.isclose(sum(kn.p(min(3, len(context) + 1), context[-2:] + c) for c in letters), 1.0)
    got = model.word_scores(["abca", "q", "zz"])
    for i, w in enumerate(["abca", "q", "zz"]):
        s = "\x02" + w + "\x03"
        want = sum(math.log(kn.p(min(3, j + 1), s[max(0, j - 2) : j + 1])) for j in range(1, len(s)))
        assert math.isclose(got[i, 0], want, rel_tol=1e-4)


def test_languages_against_plain_python():
    """Predictions, scores and rejection from the definition of the models, symbol by symbol."""
    rng, order = random.Random(12), 3
    letters = {"x": "aaabcd", "y": "dddeaf", "z": "ggghij"}
    say = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    words = {x: Counter(langid.pieces(say(x, 400))) for x in letters}
    model = langid.LanguageModel(words, order)
    held = [(say(x, rng.randint(1, 30)), x) for x in letters for _ in range(25)]
    model.calibrate([t for t, _ in held], [x for _, x in held])
    langs, alphabet = sorted(words), len({c for w in words.values() for v in w for c in v}) + 2
    plain = {x: langid.KneserNey(words[x], order, alphabet) for x in langs}

    def logp(text, lang):
        strings = ["\x02" + w + "\x03" for w in langid.pieces(text or "")]
        return sum(math.log(plain[lang].p(min(order, j + 1), v[max(0, j - order + 1) : j + 1])) for v in strings for j in range(1, len(v)))

    symbols = lambda text: sum(len(w) + 1 for w in langid.pieces(text or ""))

    def posterior(sums, n, temperature, span):
        z = [temperature * (v - max(sums)) / (1 + n / span) for v in sums]
        return [math.exp(v) / sum(map(math.exp, z)) for v in z]

    tables = [([logp(t, x) for x in langs], symbols(t), langs.index(y)) for t, y in held]
    loss = lambda t, span: sum(-math.log(max(posterior(a, n, t, span)[y], 1e-12)) for a, n, y in tables) / len(tables)
    least = min(loss(10 ** (-3 + 0.1 * i), span) for i in range(41) for span in (math.inf, 1024, 256, 64, 16))
    assert math.isclose(loss(model.temperature, model.span), least, rel_tol=1e-3, abs_tol=1e-6)
    own = {x: [-a[j] / n for a, n, y in tables if y == j] for j, x in enumerate(langs)}
    mean = {x: sum(v) / len(v) for x, v in own.items()}
    scale = {x: math.sqrt(sum((h - mean[x]) ** 2 for h in v) / len(v)) + 1e-6 for x, v in own.items()}
    reach = {x: 1.5 * max(3.0, *[abs(-a[j] / n - mean[x]) / (scale[x] + 1 / math.sqrt(n)) for a, n, y in tables if y == j]) for j, x in enumerate(langs)}
    texts = [say(x, rng.randint(1, 12)) for x in letters for _ in range(40)] + [say("x", 4) + " " + say("z", 4) for _ in range(20)] + ["qqqq rrr " * 30, "", None, "12 34", "a"]
    names, scores, bits, accepted = model.predict(texts)
    for i, text in enumerate(texts):
        n = symbols(text)
        if not n:
            assert (names[i], scores[i], accepted[i]) == ("und", 0.0, False)
            continue
        sums = [logp(text, x) for x in langs]
        best = langs[sums.index(max(sums))]
        score, far = max(posterior(sums, n, model.temperature, model.span)), (-max(sums) / n - mean[best]) / (scale[best] + 1 / math.sqrt(n)) / reach[best]
        assert names[i] == best and math.isclose(scores[i], score, rel_tol=1e-3) and math.isclose(bits[i], -max(sums) / n / math.log(2), rel_tol=1e-4)
        if abs(far - 1) > 1e-3 and abs(score - model.least) > 1e-3:
            assert accepted[i] == (far <= 1 and score >= model.least), text
    assert not accepted[texts.index("qqqq rrr " * 30)] and 0.9 < sum(accepted[:120]) / 120


def test_quality_vectors_against_plain_python():
    """Word vectors, pooling, network and temperature from their definitions, element by element."""
    q, rng = quality_classifier, random.Random(6)
    word = lambda: "".join(rng.choice("ba de ko lu".split()) for _ in range(2))
    rows = [("\n".join(" ".join(word() + ("!!" if i % 2 and rng.random() < 0.5 else "") for _ in range(rng.randint(1, 9))) for _ in range(4)), i % 2) for i in range(40)]
    model = q.QualityModel()
    model.fit(iter(rows), epochs=20)
    names = {n: w for w, n in model.words.numbers.items()}
    index = {n: [float(v) for v in q.index_vector(w)] for n, w in names.items()}
    context = {n: [0.0] * q.DIM for n in names}
    for text, _ in rows:
        a, b = model.words.stream(text)
        mixed = [int(v) for pair in zip(a, b) for v in pair]
        for i, left in enumerate(mixed):
            for right in mixed[i + 1 : i + 1 + 2 * q.WINDOW]:
                if left and right:
                    context[left] = [u + v for u, v in zip(context[left], index[right])]
                    context[right] = [u + v for u, v in zip(context[right], index[left])]
    vectors = {0: [0.0] * q.DIM}
    for n in names:
        norm = max(math.sqrt(sum(v * v for v in context[n])), 1e-9)
        vectors[n] = [u + v / norm for u, v in zip(index[n], context[n])]
        assert max(abs(u - v) for u, v in zip(vectors[n], model.vectors[n])) < 1e-3

    def logit(text):
        a, b = ([int(v) for v in part] for part in model.words.stream(text))
        pooled = [sum(vectors[n][d] for n in ids) / len(ids) if ids else 0.0 for ids in (a, b) for d in range(q.DIM)]
        x = [*pooled, math.log1p(len(a)) / 10 if a else 0.0, a.count(0) / len(a) if a else 0.0]
        x = [(v - c) / d for v, c, d in zip(x, model.center, model.spread)]
        w1, b1, w2, b2 = model.layers
        hidden = [math.tanh(sum(v * w1[i][j] for i, v in enumerate(x)) + b1[j]) for j in range(q.HIDDEN)]
        return sum(h * w for h, w in zip(hidden, w2)) + float(b2[0])

    texts = [t for t, _ in rows[:8]] + [word() + " unseen zzz", "", None, "!!! !!!\n!!! !!!"]
    for text, got in zip(texts, model.score(texts)):
        assert abs(1 / (1 + math.exp(-logit(text) / model.temperature)) - got) < 0.01
    held = [(logit(t), y) for i, (t, y) in enumerate(rows) if i % 5 == 4]
    loss = lambda tau: sum(math.log1p(math.exp((-z if y else z) / tau)) for z, y in held) / len(held)
    assert loss(model.temperature) <= min(loss(0.3 * (8 / 0.3) ** (i / 59)) for i in range(60)) + 1e-3


def test_lattice_sums_over_segmentations():
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.05, "ab": 0.15, "▁ab": 0.1, "ba": 0.1}
    lattice = lm_scoring.Lattice({k: math.log(v) for k, v in pieces.items()}, [math.log(0.001)] * 256)

    def total(s):
        if not s:
            return 1.0
        ways = sum(p * total(s[len(k) :]) for k, p in pieces.items() if s.startswith(k))
        return ways if s[0] in pieces else ways + 0.001 ** len(s[0].encode()) * total(s[1:])

    words = ["", "a", "ab", "aba", "abab", "bé", "x" * 3, "ab" * 40]
    got = lattice.log_probability(words)
    for w, p in zip(words[:-1], got):
        assert math.isclose(p, math.log(total("▁" + w)), rel_tol=1e-9)
    assert np.isfinite(got).all()
    small = lm_scoring.Lattice({k: math.log(v) for k, v in pieces.items()}, [math.log(0.001)] * 256, block=7)
    assert np.allclose(small.log_probability(words), got, rtol=1e-12)


def test_lm_score_by_hand(spark):
    """The score of a known and of an unknown word, from counts and all segmentations by recursion."""
    import sentencepiece

    rows = [(i, "aba abc aba cab") for i in range(30)] + [(100, "aba zzqx"), (101, None)]
    rows = [r for r in rows if r[0] >= 100 or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    train = F.col("doc_id") < 100
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), train).collect()}
    n = len(rows) - 2
    model = sentencepiece.SentencePieceProcessor(model_file=lm_scoring.VOCABULARY)
    seen = Counter(i for w in ("aba", "abc", "cab") for i in model.encode(w))
    lattice = lm_scoring.load_lattice(lm_scoring.VOCABULARY, dict(seen))
    weight = {}
    usable = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    rank = {i: 0.0 if model.is_byte(i) else -model.get_score(i) for i in usable}
    worst = max(rank.values())
    prior = {i: 1 / ((worst if model.is_byte(i) else rank[i]) + 10) for i in usable}
    for i in usable:
        if not model.is_byte(i):
            weight[model.id_to_piece(i)] = 0.01 * prior[i] / sum(prior.values()) + 0.99 * seen[i] / sum(seen.values())

    def ways(s):
        return 1.0 if not s else sum(weight[s[:k]] * ways(s[k:]) for k in range(1, len(s) + 1) if s[:k] in weight)

    assert math.isclose(lattice.log_probability(["zzqx"])[0], math.log(ways("▁zzqx")), rel_tol=1e-9)
    words, end, known = 4 * n, (n + 0.5) / (5 * n + 1), 1 - 1 / (4 * n + 1)
    aba = (1 - end) * (known * 2 * n / words + (1 - known) * ways("▁aba"))
    rare = (1 - end) * (1 - known) * ways("▁zzqx")
    assert math.isclose(got[100], math.log10(aba) + math.log10(rare) + math.log10(end), rel_tol=1e-9)
    assert math.isclose(got[101], math.log10(end), rel_tol=1e-9)


def test_lm_scores(docs, texts):
    for head in (1 << 19, 3):  # counts from the head, and from the join
        got = {r["doc_id"]: r for r in lm_scoring.score_texts(docs, ~held_out(F.col("doc_id"), 7, 2), head_words=head).collect()}
        tokens = {d: [*WORD.findall(lower(t)), None] for d, t in zip(ids(texts), texts)}
        c = Counter()
        for d, w in tokens.items():
            if zlib.crc32(str(d).encode()) % 7 != 2:
                c.update(w)
        n, v = sum(c.values()), len(c)
        for d, w in tokens.items():
            r = got[d]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
            assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        if head > 3:
            first = {d: r["score"] for d, r in got.items()}
        else:
            assert all(math.isclose(first[d], r["score"], rel_tol=1e-9) for d, r in got.items())


def test_toxic_clauses():
    model = toxicity.ToxicityModel()
    plain, aimed, denied, told, threat, calm = (model.measure(t)[0] for t in ("that idiot came here", "you are an idiot", "you are not an idiot", "he said you are an idiot", "i will kill you", "they will burn wood, you see"))
    assert aimed > plain > told > 0 and aimed > denied > 0 and threat > plain and calm == 0
    assert model.measure("not. you idiot")[0] > denied  # a clause ends


def test_toxic_clauses_in_four_languages():
    weigh = lambda t: toxicity.ToxicityModel().measure(t)[0]
    assert weigh("you aren\u2019t an idiot") == weigh("you aren't an idiot") < weigh("you are an idiot")
    for text in ("I will kill every last one of you", "you I will kill", "I will kill Anna", "they killed him", "eres un idiota", "je vais te tuer", "ich werde dich töten", "voy a matar a ustedes"):
        assert weigh(text) > 0, text
    assert weigh("du bist kein Idiot") < weigh("du bist ein Idiot") and weigh("no eres un idiota") < weigh("tu eres un idiota") and weigh("il dit que c'est un crétin") < weigh("c'est un crétin")
    assert weigh("the killing of time") == weigh("they will burn wood") == 0


def test_toxic_reports_cross_marks():
    weigh = lambda t: toxicity.ToxicityModel().measure(t)[0]
    said = weigh("you are an idiot")
    for text in ("he said: you are an idiot", "he said, you are an idiot", "laut Bericht: du bist ein Idiot", '"You are an idiot", he said', '"You are an idiot!" she wrote', "\u00abTu es un idiot\u00bb, dit-il", 'he wrote: "Go away, you are an idiot."'):
        assert 0 < weigh(text) < said, text
    for text in ("he said so. you are an idiot", "they said it to all of them many times, you are an idiot", 'he said: "go." you are an idiot', '"you are an idiot." then all went home and he said no'):
        assert weigh(text) == said, text


def test_toxic_words_count_in_their_language():
    weigh = lambda t: toxicity.ToxicityModel().measure(t)[0]
    assert weigh("Ich tue es für dich") == 0 < weigh("je vais te tuer")
    assert weigh("this ton of trash") == weigh("this heap of trash") and weigh("put on the trash") == weigh("put away the trash")
    for text in ("vous êtes des idiots", "ihr seid Idioten", "sois unos imbéciles", "you morons", "ihr seid Arschlöcher"):
        assert weigh(text) > 0, text
    assert weigh("he must not. ich werde dich töten") > 0 == weigh("er tue das, was die anderen tun")


def test_toxic_grammar_against_its_definition():
    """Weights of the composed transducers against rules that look at the whole sentence."""
    t, rng, grammar = toxicity, random.Random(8), toxicity.Grammar()

    def told(kinds, i):
        marks = [j for j, k in enumerate(kinds) if k in t.MARKS]
        closes = [j for j in marks if kinds[j] == t.CLOSE]
        for r in (j for j, k in enumerate(kinds) if k == t.REPORT):
            if r < i:
                m = next((j for j in marks if j > r), len(kinds))
                if m > i or m - r <= t.REACH and not any(m < j < i for j in closes):
                    return True
            else:
                m = max((j for j in marks if j < r), default=-1)
                if m > i and kinds[m] == t.CLOSE and r - m <= t.REACH and not any(i < j < m for j in closes):
                    return True
        return False

    def worth(kinds, i):
        first = max((j + 1 for j in range(i) if kinds[j] in t.MARKS), default=0)
        end = next((j for j in range(i, len(kinds)) if kinds[j] in t.MARKS), len(kinds))
        before, after = kinds[first:i], kinds[i + 1 : end]
        near = lambda some, reach, of: any(k in some for k in (of[-reach:] if of is before else of[:reach]))
        factor = (t.DENIED if near((t.NEGATION,), t.REACH, before) else 1.0) * (t.REPORTED if told(kinds, i) else 1.0)
        if kinds[i] == t.INSULT:
            return t.INSULT, factor * (t.INSULTED if near(t.PERSONS, t.REACH, before) or near(t.PERSONS, t.REACH, after) else t.BARE)
        meant = near((t.INTENT,), t.REACH, before)
        fronted = t.OBJECT in before and t.INTENT in before[max(j for j, k in enumerate(before) if k == t.OBJECT) :]
        if any(k in t.PERSONS for k in after):
            return t.THREAT, factor * t.THREATENED * (1.0 if meant else t.UNMEANT)
        if fronted:
            return t.THREAT, factor * t.THREATENED * t.BEFORE * (1.0 if meant else t.UNMEANT)
        if meant and near((t.FIRST,), t.REACH + 2, before):
            return t.THREAT, factor * t.HINTED
        return t.INSULT, factor * t.BARE

    for _ in range(6000):
        kinds = rng.choices(range(t.END), [6, 2, 2, 1, 1, 1, 1, 1, 1, 0.8, 0.6], k=rng.randint(1, 18))
        got = {i: (kind, round(w, 9)) for i, kind, w in grammar.sentence(kinds)}
        assert got == {i: (worth(kinds, i)[0], round(worth(kinds, i)[1], 9)) for i, k in enumerate(kinds) if k in t.HITS}, kinds
    assert len(grammar.forth.arcs) > 100


def test_toxic_spans(spark):
    docs = spark.createDataFrame([(1, "Calm here. You are an idiot, yes! fine"), (2, None), (None, "YOU moron"), (3, "calm")], "doc_id long, text string")
    got = {(r["doc_id"], r["clause_start"], r["clause_end"]) for r in toxicity.matched_clauses(docs, toxicity.ToxicityModel()).collect()}
    assert got == {(1, 11, 27), (None, 0, 9)}


def test_toxicity_weighs_bare_threats_and_near_copies():
    filler = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20))
    rows = [(filler(i) + (" shoot" if i % 2 else ""), i % 2) for i in range(60)]
    model = toxicity.ToxicityModel()
    model.fit(iter(rows))
    assert model.bare["shoot"] > 0 and model.measure("shoot")[0] > 0 == toxicity.ToxicityModel().measure("shoot")[0]
    copied = toxicity.ToxicityModel()
    copied.fit(iter(rows + [(filler(0) + " zork", 1)] * 400))  # one text four hundred times is one witness
    assert "zork" not in copied.fixed


def test_toxicity_learns_stems():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ba de ko lu mi".split()) for _ in range(3))
    rows = [(" ".join([word() for _ in range(60)] + ([f"zumpfo{x}" for x in rng.sample("abcdefgh", 4)] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(240)]
    model = toxicity.ToxicityModel()
    model.fit(iter(rows))
    score = model.score([word() + " zumpfoz zumpfoy", " ".join(word() for _ in range(60)), None])
    assert score[0] > 0.5 > score[1] and score[2] < 0.5


def test_quality_learns_shapes():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ba de ko lu mi".split()) for _ in range(3))
    make = lambda bad: " ".join(word() + ("###" if bad and rng.random() < 0.8 else "") for _ in range(80))
    model = quality_classifier.QualityModel()
    model.fit((make(i % 2), 1 - i % 2) for i in range(200))
    score = model.score([make(1) for _ in range(20)] + [make(0) for _ in range(20)])
    assert (score[:20] < 0.5).all() and (score[20:] > 0.5).all()

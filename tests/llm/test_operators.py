"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and copies."""

import hashlib
import html as entities
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thicket.llm import exact_dedup, html_blocks, mixing, prob_minhash, quality_knn, quality_rules, sentencepiece_scan, suffix_dedup, toxicity, wordhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(r, n, size=400):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def corpus(seed=0, n=60):
    """Random texts, exact copies in other case, near copies, a shared passage, empty and null texts, repeated rows."""
    r = random.Random(seed)
    texts = [" ".join(words(r, r.choice([3, 30, 120]))) + "." for _ in range(n)]
    texts += [t.upper() for t in texts[:5]] + texts[:5]
    for t in texts[5:20]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = " ".join(words(r, 60))
    texts += [f"{' '.join(words(r, 20))} {passage} {' '.join(words(r, 20))}" for _ in range(3)]
    texts += ["", None, "  \n ", "é ü ñ", "one", "x" * 5000]
    rows = [(k, t, "en", f"src{k % 7}" if k % 11 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[0], (None, "lost id", "en", "src1", 7), (7, "same id, other text", "en", "src2", 3)]
    return rows


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in ("_id", "_text", "_row", "kept", "score", "label", "ids"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# --- hashing -----------------------------------------------------------------------------------------------------------


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(wordhash, "SEGMENT", 64)
    text = " ".join(words(random.Random(3), 500)) + " été x\tend"
    b = wordhash.Batch([text.encode(), b"", b"w1 w2", text.encode()])
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert b.counts.tolist() == [len(parts), 0, 2, len(parts)]
    by_word = defaultdict(set)
    for w, h in zip(parts, b.hash.tolist(), strict=False):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({h for v in by_word.values() for h in v}) == len(by_word)
    h, who, _ = b.ngrams(5, whole_if_short=True)
    assert Counter(who.tolist()) == {0: len(parts) - 4, 2: 1, 3: len(parts) - 4}


# --- 1 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_scan.vocabulary(sentencepiece_scan.read_model())


SAMPLES = [
    "",
    "a",
    " leading and  double   spaces ",
    "Ünïcödé ñ 漢字かな 😀 \x00 tab\tnew\nline",
    "x" * 700,
    "antidisestablishmentarianism" * 30,
    "<s> </s> <0x0A> <unk>",
    " ".join(words(random.Random(1), 300)),
    "noSpacesAtAll,JustPunctuation;" * 40,
    "         " * 50,
    "漢字" * 300,
]


@pytest.mark.parametrize("text", SAMPLES)
@pytest.mark.parametrize("size", [5, 64, 211])
def test_chunked_encoding_equals_the_library(vocabulary, text, size):
    if size == 5 and len(text) > 400:
        text = text[:400]
    assert vocabulary.encode_in_chunks(text, size) == vocabulary.processor.encode(text)


def test_encoding_in_spark(spark, vocabulary):
    rows = [(k, t, None, None, 0) for k, t in enumerate([*SAMPLES, None, " ".join(words(random.Random(2), 4000)), "long" * 3000])]
    df = frame(spark, [*rows, rows[7]], extra=True)
    coded = sentencepiece_scan.encode(df, giant=500, chunk=120)
    got = defaultdict(list)
    for r in coded.collect():
        got[r["doc_id"]].append(list(r["ids"]))
    assert len(got[7]) == 2 and sum(map(len, got.values())) == len(rows) + 1
    for k, t, *_ in rows:
        assert got[k][0] == vocabulary.processor.encode(t or "")
    back = {r["doc_id"]: r["text"] for r in sentencepiece_scan.decode(coded).collect()}
    assert back == {k: t or "" for k, t, *_ in rows}
    assert sentencepiece_scan.digest(empty(spark)).count() == 0


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_products_are_associative(vocabulary, fan):
    """Any tree of products gives the states of one long product, and the cuts' states give the library's own tokens."""
    s = sentencepiece_scan.SPACE + ("漢字かな" * 40 + "antidisestablishment" * 8 + " a few words ").replace(" ", sentencepiece_scan.SPACE)
    cuts = [*range(0, len(s), 17), len(s)]
    ms = [vocabulary.matrix(s, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = ms[0]
    for m in ms[1:]:
        whole = (whole[:, :, None] & m[None, :, :]).any(axis=1)
    assert (sentencepiece_scan.product(ms) == whole).all()
    assert (sentencepiece_scan.product([sentencepiece_scan.product(ms[:5]), sentencepiece_scan.product(ms[5:])]) == whole).all()
    assert sentencepiece_scan.combine(ms, fan) == sentencepiece_scan.combine(ms, 10_000)


def test_giant_texts_at_the_default_size(spark, vocabulary):
    giant = " ".join(words(random.Random(9), 30_000)) + "漢字" * 5_000
    assert len(giant) > 4 * sentencepiece_scan.GIANT
    got = {r["doc_id"]: r for r in sentencepiece_scan.digest(frame(spark, [(1, giant, None, None, 0), (2, "short", None, None, 0)]), fan=3).collect()}
    ids = vocabulary.processor.encode(giant)
    assert got[1]["n_tokens"] == len(ids) and got[1]["ids_crc"] == zlib.crc32(" ".join(map(str, ids)).encode())
    assert got[1]["decoded_sha256"] == hashlib.sha256(giant.encode()).hexdigest() and got[2]["n_tokens"] == len(vocabulary.processor.encode("short"))


# --- 2 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [1024, 2])
def test_exact_dedup(spark, capacity):
    rows = corpus() + [(1000 + k, "Hot text", "en", "s", 8) for k in range(40)]
    got = exact_dedup.decide(frame(spark, rows, extra=True), capacity=capacity).collect()
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[lower(t)].append(k)
    want = Counter((k, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for k, t, *_ in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    stay = exact_dedup.keep(frame(spark, rows, extra=True), capacity=capacity)
    assert stay.columns == frame(spark, rows, extra=True).columns
    assert Counter((r["doc_id"], lower(r["text"])) for r in stay.collect()) == Counter((max((x for x in v if x is not None), default=None), t) for t, v in groups.items())
    assert exact_dedup.decide(empty(spark)).count() == exact_dedup.keep(empty(spark)).count() == 0


def test_misra_gries_bound():
    r = random.Random(0)
    keys = [b"hot"] * 400 + [f"k{r.randrange(600)}".encode() for _ in range(600)]
    r.shuffle(keys)
    counters = {}
    for k in range(0, 1000, 50):
        counters = exact_dedup.merge_summary(counters, Counter(keys[k : k + 50]), 10)
    assert 400 - 1000 / 11 <= counters[b"hot"] <= 400 and len(counters) <= 10


# --- 3 -----------------------------------------------------------------------------------------------------------------


def rule_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    covered = {p for i, x in enumerate(wins) if n[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    r = random.Random(5)
    more = ["a b\nc\na b\n\n  \n", "For " * 50, " ".join(words(r, 40) * 2), "*** | <b> é # " * 5, "x\n" * 9]
    rows = corpus() + [(500 + k, t, "en", "bad", 0) for k, t in enumerate(more * 8)]
    got = quality_rules.judge(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    want = Counter((k, *rule_counts(t)) for k, t, *_ in rows)
    assert Counter((x["doc_id"], *(x[c] for c in quality_rules.COUNTS)) for x in got) == want
    for x in got:
        assert x["base_failed"] == (x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"])
        assert x["kept"] == (not x["base_failed"] and x["host_kept"])
    # the prior and the verdicts, from the hosts' own counts
    hosts = defaultdict(list)
    for x in got:
        hosts[x["host"]].append(x["failed"])
    sizes, rates = np.array([len(v) for v in hosts.values()]), np.array([sum(v) / len(v) for v in hosts.values()])
    m, groups, total = sum(map(sum, hosts.values())) / len(got), len(hosts), len(got)
    between = (sizes * (rates - m) ** 2).sum() / (groups - 1)
    inside = (sizes * rates * (1 - rates)).sum() / (total - groups)
    per_host = (total - (sizes**2).sum() / total) / (groups - 1)
    alike = (between - inside) / (between + (per_host - 1) * inside)  # correlation within hosts
    weight = min(max(1 / alike - 1, quality_rules.PRIOR_WEIGHT[0]), quality_rules.PRIOR_WEIGHT[1])
    for x in got:
        f, n = sum(hosts[x["host"]]), len(hosts[x["host"]])
        assert (x["host_failed"], x["host_docs"]) == (f, n) and x["host_rate"] == pytest.approx((f + m * weight) / (n + weight))
        assert x["host_kept"] == (x["host_rate"] <= quality_rules.HOST_LIMIT)
    assert not next(x for x in got if x["host"] == "bad")["host_kept"]
    assert quality_rules.judge(empty(spark)).count() == 0


def test_the_prior_leaves_out_the_noise_of_small_hosts(spark):
    """Hosts of five documents each, with true rates of Beta(8, 12): the raw variance of the rates would give a weight of
    about 4, the true one is 20."""
    r = np.random.default_rng(3)
    rows = [(f"h{k}", 5, int(r.binomial(5, r.beta(8, 12)))) for k in range(6000)]
    alpha, beta = quality_rules.beta_prior(spark.createDataFrame(rows, "host string, host_docs long, host_failed long"))
    assert alpha / (alpha + beta) == pytest.approx(0.4, abs=0.01) and alpha + beta == pytest.approx(20, rel=0.25)


# --- 4 -----------------------------------------------------------------------------------------------------------------


def test_blocks():
    page = "<title>t</title><p>One &amp; two<br>three <b>four</b><p>five</p><script>x='</p>'</script><ul><li>a<li>b</ul><!-- c --><div>d<div>e</div>f</div>&lt;g"
    assert [b.text for b in html_blocks.blocks(page)] == ["One & two three four", "five", "a", "b", "d", "e", "f", "<g"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<p") == [] and [b.text for b in html_blocks.blocks("a<b")] == ["a"]


def test_gradients():
    g = html_blocks.Generator(1)
    pages = [p for p in (g.page() for _ in range(3)) if p]
    model = html_blocks.Labeller(2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = html_blocks.padded([html_blocks.vectors(p) for p in pages])
    y = np.zeros(mask.shape)
    for k, p in enumerate(pages):
        y[: len(p), k] = [b.label for b in p]
    _, grads = model.gradients(x, mask, y)
    for name in ("xf", "hb", "o", "cf"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        keep, loss = model.p[name][at], []
        for step in (1e-2, -1e-2):
            model.p[name][at] = keep + step
            loss.append(model.gradients(x, mask, y)[0])
        model.p[name][at] = keep
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(grads[name][at], rel=0.05, abs=1e-4)


def test_main_text(spark):
    model = html_blocks.trained()
    unseen = [html_blocks.Generator(777 + k).page() for k in range(60)]
    marks = np.concatenate(model.label(unseen))
    truth = np.concatenate([[b.label for b in p] for p in unseen]).astype(bool)
    assert (marks == truth).mean() > 0.95
    page = "<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>Title &amp; more</h1><p>First  text\n here.</p><p>Second one, with words.</p></article><footer>&copy; x.example</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, None, ""), (None, "w", page)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["url"]: r for r in html_blocks.extract(df, model=model).collect()}
    assert got["u"]["text"] == "Title & more\n\nFirst text here.\n\nSecond one, with words." == got["w"]["text"]
    assert got["u"]["n_chars"] == len(got["u"]["text"]) and got["v"]["text"] == "" and got[None]["n_chars"] == 0
    assert entities.unescape("&amp;") == "&"


# --- 6 -----------------------------------------------------------------------------------------------------------------


def labelled_corpus(seed=0):
    """Three kinds of texts of their own words; labels for some."""
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(240):
        kind = k % 3
        text = " ".join(f"{'abc'[kind]}{r.randrange(60)}" for _ in range(r.randint(20, 60)))
        if kind == 2:
            text += " idiot" * 3
        rows.append((k, text, "en", f"src{k % 5}", len(text)))
        if k % 2:
            labels.append((k, int(kind != 1), int(kind == 2)))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_mixing_meets_targets(spark):
    rows, labels = labelled_corpus()
    df = frame(spark, [*rows, (900, None, None, None, 0), (None, "a1 a2", "en", "x", 5)], extra=True)
    domains = mixing.label_domains(spark.createDataFrame([*labels, (1, None, None), (None, 1, 0)], LABELS))
    targets = {"clean": 1.0, "low": 0.25, "toxic": 0.1}
    weighed = mixing.weigh(df, domains, targets=targets)
    got = weighed.collect()
    assert len(got) == 242 and all(abs(sum(x["posterior"].values()) - 1) < 1e-9 and 0 <= x["rate"] <= mixing.MOST for x in got)
    kind = ("clean", "low", "toxic")
    assert sum(max(x["posterior"], key=x["posterior"].get) == kind[x["doc_id"] % 3] for x in got if x["doc_id"] is not None and x["doc_id"] < 240) > 225
    n, r = np.array([x["n_words"] for x in got]), np.array([x["rate"] for x in got])
    p = np.array([[x["posterior"][d] for d in kind] for x in got])
    assert (n * r) @ p / (n @ p) == pytest.approx([targets[d] for d in kind], abs=mixing.TOLERANCE)
    for x in mixing.achieved(weighed, targets).collect():
        assert x["by_rates"] == pytest.approx(targets[x["domain"]] , abs=mixing.TOLERANCE) and x["target"] == targets[x["domain"]]
    mixed = mixing.mix(df, domains, targets=targets)
    assert mixed.columns == df.columns
    assert Counter(x["doc_id"] for x in mixed.collect()) == Counter({x["doc_id"]: x["copies"] for x in got if x["copies"]})
    assert mixing.weigh(empty(spark), domains).count() == mixing.mix(empty(spark), domains).count() == 0
    alone = mixing.weigh(df, domains.limit(0)).collect()
    assert {tuple(x["posterior"]) for x in alone} == {("all",)} and all(x["rate"] == 1 for x in alone)


# --- 7 -----------------------------------------------------------------------------------------------------------------


def plain_spans(rows, length):
    docs = {(k, t) for k, t, *_ in rows}
    where = defaultdict(set)
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].add((k, t))
    out = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        starts = [i for i in range(len(w) - length + 1) if len(where[tuple(w[i : i + length])]) > 1]
        if starts:
            out[k, t] = suffix_dedup.merged(np.array(starts), length)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeated_passages(spark, seed):
    r = random.Random(seed)
    shared = [words(r, n) for n in (49, 50, 51, 90, 200)]
    rows = corpus(seed)
    for k in range(40):
        parts = [words(r, r.randint(0, 40)) for _ in range(3)]
        a = r.choice(shared)
        cut = r.randint(0, 30)
        parts.insert(r.randrange(4), a[cut:] if r.random() < 0.5 else a)
        rows.append((2000 + k, " ".join(w for p in parts for w in p), "en", "s", 0))
    alone = " ".join(f"copy{k}" for k in range(70))
    rows += [(2900, alone, "en", "s", 0), (2901, alone, "en", "s", 0), (2902, " ".join(alone.split()[:49]), "en", "s", 0)]
    rows.append((3000, "again " * 400, "en", "s", 0))
    rows.append((3001, "x " + "again " * 300, "en", "s", 0))
    want = plain_spans(rows, 50)
    got = suffix_dedup.digest(frame(spark, rows, extra=True)).collect()
    assert sorted(((x["doc_id"] if x["doc_id"] is not None else -1), [tuple(s) for s in x["spans"]]) for x in got) == sorted(((k if k is not None else -1), s) for (k, _), s in want.items())
    assert suffix_dedup.digest(empty(spark)).count() == 0


# --- 8 -----------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").lower().split()
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x if i in y)


def test_probability_jaccard_and_sketches():
    r = random.Random(0)
    base = words(r, 60)
    texts = [" ".join(base), " ".join(base[:50] + words(r, 10)), " ".join(base + base[:30]), "one two", ""]
    for a in texts:
        for b in texts:
            assert prob_minhash.similarity(a, b) == pytest.approx(plain_jaccard(a, b))
    who, s, w = prob_minhash.weighted_shingles(texts)
    sketch = prob_minhash.sketches(len(texts), who, s, w, m=4096)
    for i in range(3):
        for j in range(3):
            assert (sketch[i] == sketch[j]).mean() == pytest.approx(plain_jaccard(texts[i], texts[j]), abs=0.03)
    assert (sketch[3] == sketch[3][0]).all() and (sketch[4] == 0).all()


def test_one_text_against_many():
    r = random.Random(1)
    base = words(r, 40)
    texts = [" ".join(base), " ".join(base[:30]), " ".join(base + base[:12]), "one two", "", " ".join(words(r, 40))]
    known = prob_minhash.Shingled(texts)
    for i in range(len(texts)):
        assert known.similarities(i, np.arange(len(texts))) == pytest.approx([plain_jaccard(texts[i], t) for t in texts])


@pytest.mark.parametrize("limits", [{"FEW": 0}, {"BLOCK": 3, "OTHERS": 5}, {"SPLIT": 4}])
def test_near_duplicates(spark, monkeypatch, limits):
    """Buckets settled by rounds of pivots; by blocks; and cut by further bands."""
    for k, v in limits.items():
        monkeypatch.setattr(prob_minhash, k, v)
    r = random.Random(4)
    rows = corpus(4, 40)
    base = words(r, 150, 5000)
    for k in range(60):  # a chain of copies of copies, so that the class is wider than any pair
        base = list(base)
        base[r.randrange(150)] = f"new{k}"
        rows.append((4000 + k, " ".join(base), "en", "s", 0))
    texts = sorted({(t or "") for _, t, *_ in rows})
    top = {t: t for t in texts}

    def find(t):
        while top[t] != t:
            t = top[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if find(a) != find(b) and shingles(a).keys() & shingles(b).keys() and plain_jaccard(a, b) >= 0.8:
                top[find(a)] = find(b)
    classes = defaultdict(list)
    for k, t, *_ in rows:
        classes[find(t or "")].append(k)
    want = Counter((k, min((x for x in classes[find(t or "")] if x is not None), default=None), len(classes[find(t or "")])) for k, t, *_ in rows)
    df = frame(spark, rows, extra=True)
    got = prob_minhash.decide(df).collect()
    assert Counter((x["doc_id"], x["class_id"], x["class_size"]) for x in got) == want
    assert sum(x["kept"] for x in got) == len(classes) and all(x["kept"] <= (x["doc_id"] == x["class_id"]) for x in got)
    stay = prob_minhash.keep(df)
    assert stay.columns == df.columns and stay.count() == len(classes)
    assert Counter(find(x["text"] or "") for x in stay.collect()) == Counter(classes.keys())
    assert prob_minhash.decide(empty(spark)).count() == prob_minhash.keep(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        prob_minhash.decide(df, threshold=0.5)


def alike_pairs(seed, n, size=150):
    """n pairs of texts, alike by 0.81, all made from one base, so that many share a band; no others are alike."""
    r = random.Random(seed)
    base, out = words(r, size, 5000), []
    for k in range(n):
        one = list(base)
        for i in r.sample(range(size), 5):
            one[i] = f"one{k}x{i}"
        two = list(one)
        for i in r.sample(range(5, size - 5, 10), 3):
            two[i] = f"two{k}x{i}"
        out += [" ".join(one), " ".join(two)]
    return out


@pytest.mark.parametrize("split", [4, 2_048])
def test_large_buckets_lose_no_link(spark, monkeypatch, split):
    """Buckets with more members than SPLIT give the same links as smaller ones, also for pairs that share one band only."""
    monkeypatch.setattr(prob_minhash, "SPLIT", split)
    texts = alike_pairs(0, 300)
    known, many = prob_minhash.Shingled(texts), np.arange(len(texts))
    want = {(i, j) for i in range(len(texts)) for j in np.flatnonzero(known.similarities(i, many) >= 0.8).tolist() if i < j}
    assert want == {(2 * k, 2 * k + 1) for k in range(300)}
    got = prob_minhash.decide(frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])).collect()
    assert {(x["class_id"], x["doc_id"]) for x in got if x["class_id"] != x["doc_id"]} == want


def test_bound_on_the_similarity_of_what_shares_little():
    """J_P is at most 1 / (1/a + 1/b - 1), where shared elements have shares a and b of the weights."""
    g = np.random.default_rng(0)
    for k in range(300):
        n, m = g.integers(2, 40), g.integers(0, 8, 2)
        both = np.arange(n, dtype=np.uint64)
        x, y = (g.integers(1, 1 + g.integers(1, 6), n + e).astype(float) for e in m)
        a, b = (np.concatenate((both, np.arange(e, dtype=np.uint64) + np.uint64(100 * i))) for i, e in enumerate(m, 1))
        found = prob_minhash.probability_jaccard(a, x, b, y)
        assert found <= 1 / (x.sum() / x[:n].sum() + y.sum() / y[:n].sum() - 1) + 1e-9


def test_near_copies_of_large_buckets_all_go(spark, monkeypatch):
    """The pipeline's stage drops one of each pair, however many texts share the pair's only band."""
    monkeypatch.setattr(prob_minhash, "SPLIT", 4)
    docs = frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(alike_pairs(0, 300))])
    stay = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(x["doc_id"] for x in stay) == list(range(0, 600, 2))


def unlucky_pairs():
    """Pairs of texts, alike by 0.8, whose sketches share a band but agree in 32 to 34 of 64 components; and to each pair
    40 texts that are like it by less, of which some share that band."""
    out = []
    for k in (559646, 1215675, 1610318, 3959032, 4020814):
        w = [f"{k}.{i}" for i in range(14)]
        one, two = w[:13], w[:12] + w[13:]
        out.append([" ".join(x) for x in (one, two, *(one + [f"{k}.{m}.{i}" for i in range(6)] for m in range(40)))])
    return out


def test_pairs_whose_sketches_agree_little_are_linked(spark):
    """A pair is linked by its texts, in the rounds of pivots and in blocks, however few components of its sketches agree."""
    groups = unlucky_pairs()
    for one, two, *others in groups:
        assert plain_jaccard(one, two) == pytest.approx(0.8) and max(plain_jaccard(x, y) for x in (one, two) for y in others) < 0.7
        who, s, w = prob_minhash.weighted_shingles([one, two])
        a, b = prob_minhash.packed(prob_minhash.sketches(2, who, s, w))
        assert (a == b).any() and (a.view(np.uint16) == b.view(np.uint16)).sum() < 35
    docs = frame(spark, [(100 * k + i, t, "en", "s", 0) for k, g in enumerate(groups) for i, t in enumerate(g)])
    stay = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(x["doc_id"] for x in stay) == [100 * k + i for k, g in enumerate(groups) for i in range(len(g)) if i != 1]


def test_bitmaps_pass_over_no_similar_pair():
    r, texts = random.Random(2), []
    for n in (1, 3, 6, 12, 40, 200, 1500):
        base = words(r, n, 5000)
        texts += [" ".join(base), " ".join(base + base[: n // 2]), " ".join(base[: n - n // 9]), " ".join(words(r, n, 5000))]
        texts += [" ".join(base[:i] + words(r, 1) + base[i + 1 :]) for i in r.sample(range(n), min(n, 3))]
    who, s, w = prob_minhash.weighted_shingles(texts)
    bits, size = prob_minhash.bitmaps(len(texts), who, s), np.bincount(who, weights=w)
    known, many = prob_minhash.Shingled(texts), np.arange(len(texts))
    passed = 0
    for i in range(len(texts)):
        for t in (0.8, 0.9):
            may = prob_minhash.may_be_alike(bits[i], size[i], bits, size, t)
            assert may[known.similarities(i, many) >= t].all()
            passed += int((~may).sum())
    assert passed > len(texts) ** 2


# --- 9, 10 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("score", "column"), [(toxicity.score, "toxic"), (quality_knn.score, "quality")])
def test_classifiers(spark, score, column):
    rows, labels = labelled_corpus(1)
    df = frame(spark, [*rows, (900, None, None, None, 0), (901, "", "en", "s", 0), rows[0]], extra=True)
    known = spark.createDataFrame([*labels, (1, None, None), (None, 1, 0)], LABELS)
    got = score(df, known).collect()
    assert len(got) == 243 and all(0 <= x["score"] <= 1 for x in got)
    cut = 0.5 if column == "toxic" else 0.7
    assert all(x["predicted"] == (x["score"] >= cut) for x in got)
    truth = {k: (k % 3 == 2 if column == "toxic" else k % 3 != 1) for k in range(240)}
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in got if x["doc_id"] < 240) > 220
    assert all(x["predicted"] == 0 for x in got if x["doc_id"] >= 900)
    assert all(x["score"] == 0 for x in score(df, known.limit(0)).collect())
    assert score(empty(spark), known).count() == 0


def test_toxic_documents_go(spark):
    rows, labels = labelled_corpus(1)
    df = frame(spark, rows, extra=True)
    stay = toxicity.keep(df, spark.createDataFrame(labels, LABELS))
    assert stay.columns == df.columns
    left = {x["doc_id"] for x in stay.collect()}
    assert len([k for k in left if k % 3 == 2]) <= 4 and len([k for k in left if k % 3 != 2]) >= 155


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rows, labels = labelled_corpus(3)
    rows += [(k + 1000, t, *rest) for k, t, *rest in rows[:30]]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    texts = {k: t for k, t, *_ in rows}
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert set(got) == left and not [k for k in left if k < 30 and k + 1000 in texts and k % 3 != 2]
    model = sentencepiece_scan.vocabulary(sentencepiece_scan.read_model()).processor
    for k, r in got.items():
        assert r["n_tokens"] == len(model.encode(texts[k])) and r["decoded_sha256"] == hashlib.sha256(texts[k].encode()).hexdigest()


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, repeated rows, no labels, a further column; and empty tables."""
    rows, _ = labelled_corpus(5)
    rows = [*rows[:40], rows[0], (None, None, None, None, None), (None, "lost id", None, None, 7), (900, None, "en", None, None), (901, "", "en", "s", 0)]
    for name, docs in (("some", frame(spark, rows, extra=True)), ("none", empty(spark))):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], LABELS).write.parquet(f"{at}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, at).columns == docs.columns
        got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, at).collect())
        # of the empty texts the one with the largest id stays
        assert got == (Counter([*(k for k, *_ in rows[:40]), None, 901]) if name == "some" else Counter())

"""The large-corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=0, n=60):
    """(doc_id, text, lang, source, n_chars) with shared passages, copies, near copies and edge cases."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["an", "er", "th", "on", "é", "ß", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(45)
    texts = [text(r.randint(5, 160)) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = f"{text(12)} {passage}\n{text(9)}"
    texts[1] = texts[2]
    words = texts[3].split() + text(120).split()
    texts[3] = " ".join(words)
    words[4] = "changed"
    texts[4] = " ".join(words)
    texts += [None, "", " \n\t", "a", "a b c", "x " * 3000, "same line of words\n" * 40, passage]
    return [(i, t, ["en", "fr", None][i % 3], "src", None if t is None else len(t)) for i, t in enumerate(texts)] + [(7, texts[7], "en", "src", 1), (None, texts[8], "en", "src", 1)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return tuple((v is None, v) for v in r)


def test_substring_dedup(docs, empty):
    from tidewarden.llm.doubling import levels, substring_dedup

    rows = [(i, [w.decode() for w in WORD.findall((t or "").encode())]) for i, t, *_ in corpus()]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    expected = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup(docs, 35, group_bytes=4000).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert substring_dedup(empty).count() == 0 and levels(35) == [9, 18, 35] and levels(5) == [5]


@pytest.mark.parametrize("hot", [2, 500])
def test_suffix_dedup(docs, empty, hot):
    from tidewarden.llm.suffix import suffix_dedup

    rows = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    least = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            least[s] = min(least.get(s, math.inf), math.inf if i is None else i)
    expected = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < (math.inf if i is None else i):
                gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        expected.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [tuple(r) for r in suffix_dedup(docs, group_bytes=4000, hot_docs=hot).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert suffix_dedup(empty).count() == 0


def test_run_index_statistics():
    from tidewarden.llm.rindex import RunIndex

    rng = np.random.default_rng(3)
    for _ in range(25):
        window, letters = int(rng.integers(2, 8)), int(rng.integers(1, 4))
        strings = list({bytes(rng.integers(97, 97 + letters, rng.integers(window, 25)).astype(np.uint8)) for _ in range(12)})
        owner = rng.integers(0, 50, len(strings))
        patterns = [*strings, b"abcabcxyzabc"]
        flat = lambda x: (np.frombuffer(b"".join(x), np.uint8), np.array([len(s) for s in x]))
        first, length, least = RunIndex(*flat(strings), owner, window).statistics(*flat(patterns))
        mine = RunIndex(*flat(strings), owner, window).statistics(*flat(strings), own=True)
        assert (mine[2][: len(least)] == least[: len(mine[2])]).all() and (np.minimum(mine[1], window) == np.minimum(length, window)[: len(mine[1])]).all()
        for p, s in enumerate(patterns):
            for i in range(len(s)):
                best = max((k for k in range(len(s) - i + 1) if any(s[i : i + k] in t for t in strings)), default=0)
                assert min(length[first[p] + i], window) == min(best, window)
                if best >= window:
                    assert least[first[p] + i] == min(o for o, t in zip(owner, strings) if s[i : i + window] in t)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    from tidewarden.llm.packing import default_tokenizer, pack, plan

    model = Tokenizer.from_file(default_tokenizer())
    rows = [*corpus(), (70, "a<|endoftext|> b <|endoftext|><|endoftext", "en", "src", 1)]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(rows[-1:], DOCS))
    expected = []
    for i, t, *_ in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        count = -(-len(ids) // 128)
        cuts = [0, *[len(ids) - 128 * k for k in range(count - 1, -1, -1)]]
        expected += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [tuple(r) for r in pack(docs, 128).collect()]
    assert sorted((r[:5] for r in got), key=key) == sorted(expected, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r[5]].append((r[6], r[3]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= 1.1 * sum(r[3] for r in got) / 128 + 1
    assert pack(empty).count() == 0
    for most, histogram in ((10, {7: 3, 3: 5, 10: 2, 1: 4}), (5, {5: 1}), (9, {2: 1000, 9: 1})):
        taken = Counter()
        for length, rank, n, each, *_ in plan(histogram, most):
            assert rank == taken[length]
            taken[length] += n * each
        assert taken == histogram


def test_long_texts_are_encoded_in_spans():
    from tidewarden.llm.packing import Encoder, default_tokenizer

    text = "some words here. And 12 numbers\n\n" * 300
    e = Encoder(default_tokenizer())
    assert e.ids(text, 500).tolist() == e.ids(text).tolist()


def test_url_filter(spark):
    from tidewarden.llm.urlfilter import DEMO_RULES, filter_urls, rules_frame

    urls = ["http://EXAMPLE.org/es/1", "https://m.example.org/en/17?x", "http://example.org/en/2#t", "http://notexample.org/es/", "http://a.com/de/x", "http://a.com/it/", "http://org", "http://x.org", "no scheme", "", None, "http://example.org/es/1", "ftp://u@org:8/es/"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")

    def judge(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + p), h + p, v) for h, p, v in DEMO_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = {r.page_id: tuple(r)[1:] for r in filter_urls(pages, rules_frame(spark, DEMO_RULES)).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert filter_urls(pages.limit(0), rules_frame(spark, DEMO_RULES)).count() == 0
    assert filter_urls(pages, rules_frame(spark, DEMO_RULES).limit(0)).where("rule is null and verdict = 'allow'").count() == len(urls)


def test_warc_round_trip_and_lookup(spark, tmp_path):
    from tidewarden.llm import warc

    rows = [(1, "http://a.org/x", "same"), (2, "http://B.a.org/y", "same"), (3, "http://a.org/x", "café"), (4, None, None), (5, "odd url\r\nx", ""), (6, "http://a.org/z", "z" * 50_000), (None, "http://n.org/", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, file_bytes=2_000)
    got = {r.page_id: r for r in warc.lookup(spark, path, warc.wanted_keys(pages, id_col="page_id"), each=3).collect()}
    assert len(got) == len(rows)
    heads = {}
    for i, _, h in rows:
        if i is not None:
            heads[h or ""] = max(heads.get(h or "", 0), i)
    for i, u, h in rows:
        body = (h or "").encode()
        r = got[i]
        revisit = i is not None and heads[h or ""] != i
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), u)
        assert (r.record_type, r.refers_to) == (("revisit", heads[h or ""]) if revisit else ("response", None)) and r.intact
        assert bytes(r.body) == (b"" if revisit else body)
    ask = lambda *urls: sorted((r.page_id, bytes(r.body)) for r in warc.lookup(spark, path, warc.wanted_keys(spark.createDataFrame([(u,) for u in urls], "url string"))).collect())
    assert ask("https://a.org/x", "http://none.org/") == [(1, b""), (3, "café".encode())]
    assert ask("http://none.org/") == []
    warc.write_archives(pages, str(tmp_path / "r"), least_revisit=5)
    assert warc.lookup(spark, str(tmp_path / "r"), warc.wanted_keys(pages, id_col="page_id")).where("record_type = 'revisit'").count() == 0
    # rows that repeat wholly or in their id, one url very often, blocks of two lines
    many = [(i % 40 if i % 3 else None, f"http://a.org/{0 if i % 2 else i}", f"b{i % 7}") for i in range(300)]
    often = spark.createDataFrame(many, "page_id long, url string, html string")
    warc.write_archives(often, str(tmp_path / "m"), file_bytes=500)
    warc.write_index(warc.index_entries(spark, str(tmp_path / "m")), str(tmp_path / "m"), block_lines=2, file_bytes=100)
    back = warc.lookup(spark, str(tmp_path / "m"), warc.wanted_keys(often, id_col="page_id"), each=5).select("page_id", "url", "payload_digest").collect()
    assert sorted(back, key=key) == sorted(((i, u, warc.digest32(h.encode())) for i, u, h in many), key=key)
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.lookup(spark, str(tmp_path / "e"), warc.wanted_keys(pages)).count() == 0


def test_winnowing_with_short_items(spark, docs, empty):
    from tidewarden.llm.winnow import decontaminate

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    texts = [t for _, t, *_ in corpus() if t and len(t.split()) > 40]
    items = [(1, " ".join(texts[0].split()[3:25])), (2, texts[6][:3] + " ; " + " ".join(texts[6].split()[5:9])), (10, "A"), (3, "none of these words"), (4, None), (5, ""), (11, " ".join(texts[0].split()[3:25]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[k : k + n])].add(str(i))
    expected = []
    for i, t, *_ in corpus():
        w, hit, names = words(t), set(), set()
        for g, found in wanted.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names |= found
        expected.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    for most in (1_000_000, 0):
        got = [tuple(r) for r in decontaminate(docs, benchmark, most_broadcast=most).collect()]
        assert sorted(got, key=key) == sorted(expected, key=key)
    assert decontaminate(empty, benchmark).count() == 0
    assert decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_quality_rules(spark, docs, empty):
    import sentencepiece

    from tidewarden.llm.fertility import BANDS, default_model, quality_rules, script_of

    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    r = random.Random(8)
    vocabulary = ["".join(r.choice(["an", "er", "th", "on", "ing", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    prose = [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(60, 120))), ["en", "fr", None][i % 3], "s", 1) for i in range(300)]
    junk = [(2000 + i, " ".join(r.choice(vocabulary) + r.choice(["###", "%%%", "$$$"]) for _ in range(90)), "en", "s", 1) for i in range(9)]
    rows = [*corpus(), *prose, *junk]
    expected = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = set()
        for k in range(len(w) - 2):
            if tri[tuple(w[k : k + 3])] > 1:
                rep |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tokens = [x for word in w for x in model.encode(word)]
        share = np.array(list(Counter(tokens).values())) / max(len(tokens), 1)
        chars = sum(map(len, w))
        expected.append([
            i, lang or "script latin", len(w), chars, len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(tokens), chars / max(len(tokens), 1),
            len(tokens) / max(len(w), 1), sum(model.is_byte(x) for x in tokens) / max(len(tokens), 1), float(-(share * np.log2(share)).sum()), len(w) < 50 or 100 * len(rep) > 50 * len(w),
        ])
    length = lambda e: min(max(int(math.log2(max(e[2], 1))), 5), 10)
    for e in expected:
        why = "base" if e[12] else None
        fit = [x for x in expected if not x[12] and x[1] == e[1]]
        own = [x for x in fit if length(x) == length(e)]
        fit = own if len(own) >= 40 else fit
        for at, m in ((8, "chars_per_token"), (9, "tokens_per_word"), (10, "byte_share"), (11, "token_entropy")):
            if why is None and len(fit) >= 40:
                low, mid, high = np.quantile([round(x[at], 3) for x in fit], (0.25, 0.5, 0.75))
                if m == "byte_share":
                    bad = e[at] > mid + 0.1
                else:
                    band = BANDS[m]
                    bad = e[at] < mid - band.below * max(high - mid, band.floor) or (band.above and e[at] > mid + band.above * max(mid - low, band.floor))
                why = m if bad else None
        e += [why, why is None]
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [tuple(x) for x in quality_rules(table, default_model()).collect()]
    for x, y in zip(sorted(got, key=key), sorted(map(tuple, expected), key=key), strict=True):
        assert x[:8] == y[:8] and np.allclose(x[8:12], y[8:12]) and x[12:] == y[12:]
    kept = {x[0] for x in got if x[-1]}
    assert not kept & {i for i, *_ in junk} and len(kept & {i for i, *_ in prose}) >= 297
    assert quality_rules(empty, default_model()).count() == 0
    assert quality_rules(docs.drop("lang"), default_model()).count() == len(corpus())
    assert [script_of(x.encode()) for x in ("abc é", "привет", "日本のこと", "中文字", "한국어", "12", "")] == ["latin", "cyrillic", "kana", "han", "hangul", "latin", "latin"]


def test_signature_estimates_weighted_similarity():
    from tidewarden.llm.dartminhash import signatures

    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        n = int(rng.integers(2, 120))
        e = rng.integers(0, 2**63, n, dtype=np.uint64)
        a = rng.integers(1, 5, n).astype(float)
        b = np.where(rng.random(n) < 0.6, a, rng.integers(0, 5, n)).astype(float)
        b[0] = 1
        sig = signatures(np.concatenate([np.zeros(n, int), np.ones(int((b > 0).sum()), int)]), np.concatenate([e, e[b > 0]]), np.concatenate([a, b[b > 0]]), 2, 120)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.025 and np.std(errors) < 0.08


def test_near_duplicates(docs, empty, spark):
    from tidewarden.llm.dartminhash import near_duplicates

    sets = {}
    for i, t, *_ in corpus():
        w = WORD.findall((t or "").encode())
        if i is not None and w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i, *_ in corpus()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert r.class_id == (None if r.doc_id is None else find(r.doc_id))
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_among_the_few_of_a_large_bucket(spark):
    from tidewarden.llm.dartminhash import near_duplicates

    r = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    # 169 texts with five own changes each, of which two texts share at most one place: all just below 0.8 to each other
    lines = [(a, b) for a in range(13) for b in range(13)]
    place = lambda i, j: 5 + 6 * (13 * j + (lines[i][0] + lines[i][1] * j) % 13)
    tag = {(i, j): f"o{i}" for i in range(169) for j in range(5)}
    used = set()
    for i in range(0, 169, 20):  # a few pairs share one change, and are near to each other alone
        k, j = next((k, j) for j in (1, 2, 3) for k in r.sample(range(169), 169) if k != i and not {i, k} & used and place(i, j) == place(k, j))
        used |= {i, k}
        tag[k, j] = tag[i, j]
    texts = [list(base) for _ in range(169)]
    for i, j in tag:
        texts[i][place(i, j)] = tag[i, j]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert len({find(i) for i in range(len(texts))}) == 160
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_duplicates(rows).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_language_model(docs, empty):
    from tidewarden.llm.interpolation import is_held_out, learn, score

    rows = [(i, [w.lower() for w in WORD.findall((t or "").encode())] + [b"\0end"]) for i, t, *_ in corpus()]
    counts = Counter(x for i, w in rows if not is_held_out(i) for x in w)
    total, distinct = sum(counts.values()), len(counts)
    for order in (2, 3):
        got = score(docs, order=order, group_bytes=4000).collect()
        assert len(got) == len(rows)
        by = defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
        for i, w in rows:
            base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
            assert all((r.held_out, r.train_tokens) == (is_held_out(i), total) for r in by[i])
            assert any((r.n_tokens, r.n_known) == (len(w), sum(counts[x] > 0 for x in w)) and abs(r.base_score - base) < 1e-6 * (1 - base) for r in by[i])
        assert all(r.score < 0 for r in got)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score(empty).count() == 0
    weights = learn({(130, 200): 90, (130, -1): 10, (0, -1): 5}, 1e-3, 2)
    assert abs(weights[130].sum() - 1) < 1e-9 and weights[130][1] > 0.5 and weights[0].tolist() == [1, 0]


def test_language_model_against_brute_force(spark, docs):
    from tidewarden.llm import exchange as X
    from tidewarden.llm.interpolation import is_held_out, score

    order, n = 3, 8
    group = docs.select("doc_id", "text", X.group_of(n).alias("g")).collect()
    rows = [(r.doc_id, r.g, [w.lower() for w in WORD.findall((r.text or "").encode())] + [b"\0end"]) for r in group]
    grams = lambda w: [[tuple(([b"\0start"] * 3 + w)[k + 3 - j : k + 4]) for k in range(len(w))] for j in range(order)]
    total, own = Counter(), defaultdict(Counter)
    for i, g, w in rows:
        if not is_held_out(i):
            for each in [*grams(w), [(b"\0start",)], [(b"\0start",) * 2]]:
                total.update(each)
                own[g].update(each)
    vocabulary = len([k for k in total if len(k) == 1 and k != (b"\0start",)])
    tokens = sum(v for k, v in total.items() if len(k) == 1 and k != (b"\0start",))

    def parts(gram, count, size):
        bucket, out = 0, [(count(gram[-1:]) + 1) / (size + vocabulary + 1)]
        for j in range(2, order + 1):
            seen = count(gram[-j:-1])
            out.append(count(gram[-j:]) / seen if seen else 0.0)
            if seen:
                bucket = 64 * j + int(math.log2(seen)) + 1
        return bucket, out

    held = defaultdict(list)
    for i, g, w in rows:
        if not is_held_out(i):
            for gram in grams(w)[-1]:
                bucket, p = parts(gram, lambda k: total[k] - own[g][k], tokens * (1 - 1 / n))
                held[bucket].append(p)
    weights = {}
    for bucket, ps in held.items():
        p = np.array(ps)
        open_ = np.arange(order) < max(bucket // 64, 1)
        weight = open_ / open_.sum()
        for _ in range(60):
            share = p * weight
            share /= share.sum(axis=1, keepdims=True)
            weight = share.sum(axis=0) + 0.5 * open_
            weight /= weight.sum()
        weights[bucket] = weight

    def weight_of(bucket):
        near = [b for b in weights if b // 64 == bucket // 64]
        return weights[min(near, key=lambda b: abs(b - bucket))] if near and bucket // 64 > 1 else np.eye(order)[0]

    expected = []
    for i, _, w in rows:
        s = 0.0
        for gram in grams(w)[-1]:
            bucket, p = parts(gram, lambda k: total[k], tokens)
            s += math.log10(float(np.dot(weight_of(bucket), p)))
        expected.append((i, len(w), s))
    got = [(r.doc_id, r.n_tokens, r.score) for r in score(docs, order=order, group_bytes=1 << 30).collect()]
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 0.02 * abs(b[2]) + 0.02


def test_language_model_uses_contexts_seen_once(spark):
    from tidewarden.llm.interpolation import is_held_out, score

    held = [i for i in range(400) if is_held_out(i)]
    train = [i for i in range(400) if not is_held_out(i)]
    passage = lambda k: " ".join(f"p{k}w{j}" for j in range(40))
    # passages 0-9 stand twice in training text, so a deleted occurrence has a context seen once; passage 99 stands once
    rows = [(train[2 * k + j], passage(k)) for k in range(10) for j in range(2)] + [(train[50], passage(99)), (held[0], passage(99)), (held[1], " ".join(reversed(passage(99).split())))]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=1000).collect()}
    copied, mixed = got[held[0]], got[held[1]]
    assert copied.n_known == copied.n_tokens == 41 and copied.score / 41 > -0.5 and copied.base_score / 41 < -2
    assert mixed.score / 41 < -2


def _kneser_ney(texts, order):
    """Brute force: a function from (context, byte) to probability."""
    counts = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        b = bytes([2]) * (order - 1) + re.sub(rb"[0-9]", b"0", t) + bytes([3])
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        got = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else 0 for i in (1, 2, 3)]
        cut[k] = [d if 0 < d < i else 0.5 * i for i, d in zip((1, 2, 3), got)]
    after = defaultdict(list)
    for k, c in counts.items():
        for g, v in c.items():
            after[k, g[:-1]].append(v)

    def p(g):
        k = len(g)
        q = p(g[1:]) if k > 1 else 1 / 256
        seen = after.get((k, g[:-1]))
        if not seen:
            return q
        c = counts[k][g]
        d = lambda v: cut[k][min(v, 3) - 1] if v else 0
        return (max(c - d(c), 0) + sum(map(d, seen)) * q) / sum(seen)

    return p


def test_kneser_ney_against_brute_force(spark, docs):
    from tidewarden.llm.kneser_ney import is_held_out, perplexities

    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    p = _kneser_ney([(t or "").encode() for i, t, *_ in corpus() if i is not None and i % 2 == 0 and i < 60 and not is_held_out([i], 4)[0]], 5)
    assert abs(sum(p(b"anth" + bytes([b])) for b in range(256)) - 1) < 1e-9
    expected = []
    for i, t, lang, *_ in corpus():
        b = bytes([2]) * 4 + re.sub(rb"[0-9]", b"0", (t or "").encode()) + bytes([3])
        each = [-math.log10(p(b[k : k + 5])) for k in range(len(b) - 4)]
        words = [m.span() for m in re.finditer(rb"[A-Za-z0-9\x80-\xFF]+", b[4:-1])]
        worst = max((sum(each[x:y]) / (y - x) for x, y in words if y - x >= 4 and not re.search(rb"[0-9]", b[4:][x:y])), default=0.0)
        expected.append((i, lang, i is not None and i % 2 == 0 and i < 60, len(b) - 5, sum(each), worst))
    for size in (3000, None):
        got = [(r.doc_id, r.lang, r.trusted, r.n_bytes, -r.log10_prob, r.worst_word) for r in perplexities(docs, trusted, group_bytes=size).collect()]
        for x, y in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
            assert x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-4 * (1 + y[4]) and abs(x[5] - y[5]) < 1e-4


def test_quality_classifier_separates_and_keeps(spark, docs, empty):
    from tidewarden.llm.kneser_ney import classify

    r = random.Random(1)
    syllables = ["an", "er", "th", "on", "ti"]
    word = lambda: "".join(r.choice(syllables) for _ in range(3))
    prose = [(i, " ".join(word() for _ in range(60)), "en") for i in range(120)]
    junk = [(200 + i, " ".join("".join(r.choice("QXZ#|&7") for _ in range(6)) for _ in range(60)), "en") for i in range(5)]
    odd = [(300 + i, " ".join([*(word() for _ in range(2000)), "wuvvyk", *(word() for _ in range(2000))]), "en") for i in range(5)]
    rows = spark.createDataFrame([*prose, *junk, *odd, (400, None, None), (401, "", "x\0x"), (402, "an er", ""), (None, "an er", "en")], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(80)] + [(None,)], "doc_id long")
    got = {x.doc_id: x for x in classify(rows, trusted, group_bytes=5000).collect()}
    assert len(got) == 134 and not any(got[i].kept for i in (*range(200, 205), *range(300, 305)))
    # unseen clean text is kept as well as what was learned
    assert sum(got[i].kept for i in range(80)) >= 76 and sum(got[i].kept for i in range(80, 120)) >= 38
    assert got[400].kept and got[401].kept and got[0].trusted and not got[100].trusted and not got[None].trusted
    assert (got[400].lang, got[401].lang, got[402].lang) == (None, "x\0x", "")
    assert classify(docs, trusted.limit(0)).where("kept").count() == len(corpus())
    assert classify(empty, trusted).count() == 0


def test_keys_and_arrays_pack_and_unpack():
    from tidewarden.llm import exchange as X
    from tidewarden.llm import kernels as K

    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (X.unpack_keys(X.pack_keys(keys)) == keys).all() and len(X.unpack_keys(X.pack_keys(keys[:0]))) == 0
    assert (K.unmix(K.mix(keys)) == keys).all()
    assert X.unpack_array(X.pack_array(np.array([1, 2, 300], np.uint32))).tolist() == [1, 2, 300]
    uniq, place = K.unique_inverse(keys[[3, 1, 3, 2]])
    assert (uniq[place] == keys[[3, 1, 3, 2]]).all()


def test_rows_between_groups_and_buckets_grow_with_the_input():
    from tidewarden.llm import exchange as X

    for size in (2 << 30, 50 << 30, 500 << 30):
        rows = [X.group_count(size * k) ** 2 for k in (1, 4)]
        assert rows[1] <= 4.2 * rows[0]
    assert X.group_count(1 << 20) == 1 and X.group_count(100, 10) == 10


def test_null_and_repeated_ids_fill_no_group(spark):
    from tidewarden.llm import exchange as X

    rows = spark.createDataFrame([(None if i % 2 else 5, f"text {i}") for i in range(800)], "doc_id long, text string")
    groups = {r.g: r.n for r in rows.groupBy(X.group_of(8).alias("g")).count().withColumnRenamed("count", "n").collect()}
    assert len(groups) == 8 and max(groups.values()) < 150


def test_settled_rows_are_counted_and_leave_no_shuffle_setting(spark):
    from tidewarden.llm import exchange as X

    before = spark.conf.get(X._CLEANUP)
    df, n = X.settle(spark.range(1000).repartition(7).groupBy("id").count(), each=300)
    assert n == 1000 and df.count() == 1000 and df.rdd.getNumPartitions() <= 4 and spark.conf.get(X._CLEANUP) == before
    assert X.settle(spark.range(0))[1] == 0


def test_settled_rows_pass_on_no_estimate_of_their_size(spark):
    """Spark takes the product of two sides for the size of their join; over rounds of settled joins the number's digits doubled, up to the driver's memory."""
    from pyspark.sql import functions as F

    from tidewarden.llm import exchange as X

    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    for _ in range(6):
        df, n = X.settle(df.join(df.select("id", F.col("v").alias("w")), "id").select("id", F.col("w").alias("v")))
    assert n == 100 and sorted(map(tuple, df.collect())) == [(i, i % 7) for i in range(100)]
    assert len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20


def test_components_of_a_path_keep_estimates_small(spark):
    """Rounds of hooks and jumps leave estimates of a table's size as short as they were, and each component its least id."""
    from tidewarden.llm.dartminhash import components

    order = random.Random(6).sample(range(1, 41), 40)
    edges = [*zip(order[:25], order[1:25], strict=False), *zip(order[25:], order[26:], strict=False)]
    nodes = spark.createDataFrame([(i, i) for i in order], "id long, root long")
    got = components(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.root for r in got.collect()} == {i: min(part) for part in (order[:25], order[25:]) for i in part}
    assert len(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20


def test_weighted_and_plain_similarity_both_link(spark):
    from tidewarden.llm.dartminhash import near_duplicates

    r = random.Random(3)
    text = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(900)) for _ in range(n))
    line, a, tail = text(12), text(60), text(12)
    rows = [
        (1, f"{a} {' '.join([line] * 3)}"), (2, f"{a} {' '.join([line] * 30)}"),  # the same distinct shingles, other counts
        (11, f"{' '.join([line] * 60)} {text(25)}"), (12, f"{' '.join([line] * 60)} {text(25)}"),  # alike by counts alone
        (21, tail), (22, f"{text(30)} {tail}"),
    ]
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 11: 11, 12: 11, 21: 21, 22: 22}


def test_shared_ids_join_the_classes_of_their_texts(spark):
    from tidewarden.llm.dartminhash import near_duplicates

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(3, a), (4, b), (5, a), (5, b), (6, c), (7, d), (8, c), (8, d), (9, d), (9, a), (10, "alone by itself in the whole table"), (None, a)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got if r.doc_id) == [(i, 3, 10) for i in (3, 4, 5, 5, 6, 7, 8, 8, 9, 9)] + [(10, 10, 1)]
    assert [(r.class_id, r.class_size) for r in got if r.doc_id is None] == [(None, 1)]


def test_run_index_work_is_done_once():
    """Cutting finds the places of segments as sending does, without the bytes; suffixes that share more than a packed word keep the order of their ends."""
    import numpy as np

    from tidewarden.llm import exchange as X
    from tidewarden.llm import suffix
    from tidewarden.llm.rindex import RunIndex

    texts = [b"the same long passage of some sixty bytes stands in both of them " + bytes([97 + k]) * 30 for k in range(3)] + [None, b"short", b"ab" * 90]
    ids = [5, 3, 9, 1, None, 2]
    keys = np.unique(np.concatenate([suffix._Bytes([t or b"" for t in texts], 50, 20).first_level()]))
    got = [(0, 0, X.join_blobs([X.pack_keys(keys), X.pack_keys(keys[:0])]))]
    sent, cut = (suffix._gather(ids, texts, got, 50, 20, sent=s) for s in (True, False))
    assert len(sent[3]) == sent[1].sum() and len(cut[3]) == len(cut[2]) == 0
    assert all(np.array_equal(sent[k], cut[k]) for k in (0, 1, 4, 6)) and len(sent[4])
    body = [b"abcabcabcabcabcabcabcabcabcabcab", b"abcabcabcabcabcabcabcabcabcabcab", b"cabcabcabcabcabcabcabcabcabcabcx"]
    index = RunIndex(np.frombuffer(b"".join(body), np.uint8), np.array([len(b) for b in body]), np.arange(3), 8)
    order, whole = index._sort(), b"\0".join(body) + b"\0"
    ends = [k for k, c in enumerate(whole) if not c]
    tail = lambda p: (whole[p : (e := next(x for x in ends if x >= p))], e)
    assert order.tolist() == sorted(range(len(whole)), key=tail)


def test_run_index_runs_are_whole():
    """A run ends where its symbol does, not where neighbours share few symbols; rows that share a window carry its least owner; pieces are told apart by their bytes, whatever their hashes."""
    import numpy as np

    from tidewarden.llm import suffix
    from tidewarden.llm.rindex import RunIndex

    rng = np.random.default_rng(11)
    for window in (3, 12, 50):
        strings = list({bytes(rng.choice([97, 98, 200], int(rng.integers(window, 90))).astype(np.uint8)) for _ in range(30)})
        strings += [s + b"ba" for s in strings[:9]] + [b"c" + s for s in strings[5:12]]
        owner = rng.permutation(len(strings))
        body, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
        index = RunIndex(body, sizes, owner, window)
        assert (index.run_symbol[1:] != index.run_symbol[:-1]).all()
        first, length, least = index.statistics(body, sizes, own=True)
        for at, s in zip(first, strings, strict=True):
            assert length[at : at + len(s)].tolist() == list(range(len(s), 0, -1))
            for k in range(len(s)):
                mine = s[k : k + window]
                assert least[at + k] == (min(o for o, t in zip(owner, strings, strict=True) if mine in t) if len(mine) == window else np.iinfo(np.int64).max)

    pieces = [b"one piece", b"two piece", b"one piece", b"longer piece", b"two piece", b"one piece"]
    size = np.array([len(x) for x in pieces])
    buf, start = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
    key = np.array([7, 7, 7, 3, 7, 9], np.uint64)
    for told in (suffix._hashes(buf, start, size), np.zeros(6, np.uint64)):
        differ, place = suffix._alike(buf, start, size, key, told)
        assert [(pieces[differ[p]], key[differ[p]]) for p in place] == list(zip(pieces, key, strict=True)) and (np.diff(key[differ].astype(int)) >= 0).all()
        assert len(differ) == 4 or not told.any()
    assert suffix._copied(buf, start[[3, 1, 0]], size[[3, 1, 0]]).tobytes() == b"longer piecetwo pieceone piece"

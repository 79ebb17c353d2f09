"""The corpus operators against brute force, round trips and held-out accuracy, and their odd cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from centra.llm import bpe, language_id, licenses, lm_score, mixing, neighbours, quality, simhash, substrings, suffix, url_filter
from centra.operators.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, block long, fp long, sign string, h int, root int, copies int, kept string"
LONG = "word " * 30_000 + "end."


def odd_rows():
    base = "the quick brown fox jumps over the lazy dog and runs away from the angry bear that lives in the dark forest near here. "
    return [
        (1, base * 3, "en", "a", 1), (2, base * 3, "en", "a", 1), (2, base * 3, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0),
        (5, " \n\t", None, "b", 3), (None, "le chat est sur la table avec la souris. " * 5, "fr", "b", 9), (None, None, "de", None, None),
        (6, LONG, "en", "c", 5), (7, "%%% 123 ...", "en", None, 1), (8, "naïve Ünïcode — 漢字 ​x'll don't 　end", "de", "c", 2), (9, "le chat est sur la table avec la souris. " * 5, "fr", "b", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 0.5, 1, 2, "s", 3, 4, 5, "k") for r in odd_rows()]
    return spark.createDataFrame(rows, CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


# --- language identification


def path_score(scores, path, switch):
    return scores[np.arange(len(path)), path].sum() - switch * np.count_nonzero(np.diff(path))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for n, k in itertools.product((1, 2, 5, 7), (1, 2, 3)):
        for _ in range(30):
            scores = rng.normal(0, 4, (n, k))
            best = max(path_score(scores, np.array(p), 3.0) for p in itertools.product(range(k), repeat=n))
            assert path_score(scores, language_id.viterbi(scores, 3.0), 3.0) == pytest.approx(best)


def test_language_held_out_accuracy_and_spans(spark, docs):
    model = language_id.fit_documents(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.fold(F.col("doc_id")) == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    text = {k: docs.where(F.col("lang") == k).first().text[:1500] for k in ("en", "fr")}
    mixed = text["en"] + "\n" + text["fr"]
    row = language_id.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert {s.lang for s in row.spans} == {"en", "fr"} and all(0 <= s.start < s.end <= len(mixed) for s in row.spans)


def test_long_texts_are_labelled_in_pieces(docs, monkeypatch):
    model = language_id.fit_documents(docs)
    text = "\n".join(r.text for r in docs.limit(20).collect())
    whole = list(language_id._label([text], model))
    monkeypatch.setattr(language_id, "CHUNK_CHARS", 700)
    assert list(language_id._label([text], model)) == whole
    assert [x for _, part in language_id._chunks([None, "a", text, "b" * 300, "c" * 500, "d"]) for x in part] == ["", "a", text, "b" * 300, "c" * 500, "d"]


def test_language_odd_cases(odd, empty):
    model = language_id.fit_documents(odd)
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {3, 4, 5, 7} <= und and 1 not in und and all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(empty, language_id.fit_documents(empty)).collect() == []
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit_documents(empty)).collect()} == {"und"}
    kept = language_id.stage(None, odd, "")
    assert kept.columns == odd.columns and kept.count() == len([r for r in got if r.lang_pred != "und" and r.score >= language_id.LEAST_SCORE])


# --- substrings


@pytest.mark.parametrize("cost", [0, 40, 10**9])
def test_suffix_array(cost, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET_COST", cost)
    rng = random.Random(cost)
    for _ in range(200):
        t = [rng.randrange(rng.randint(1, 5)) for _ in range(rng.randint(0, 50))] * rng.choice((1, 1, 3))
        sa = suffix.suffix_array(np.array(t, np.int64))
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        data = np.array(t, np.uint8)
        if len(t) > 1:
            prefix = suffix.permuted_common_prefixes(data, sa, 16)
            for a, b in zip(sa[:-1], sa[1:]):
                same = next((k for k in range(16) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or b + k >= len(t) or a + k >= len(t)), 16)
                assert prefix[b] == same


def brute_substrings(rows, window=100):
    seen, out = set(), defaultdict(list)
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc_id].append((len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def as_lists(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("hot", [substrings.HOT_CONTEXTS, 2])
def test_substrings_match_brute_force(docs, hot):
    assert as_lists(substrings.digests(docs, hot).collect()) == brute_substrings([(r.doc_id, r.text) for r in docs.collect()])


def test_portions_are_whole_bins():
    rng = np.random.default_rng(7)
    size, bins = rng.integers(100, 169, 40_000), np.minimum(rng.integers(0, 400, 40_000), substrings.BINS - 1).astype(np.uint8)
    found = substrings.portions(size, bins)
    assert sorted(np.concatenate(found).tolist()) == list(range(len(size)))
    of = [set(bins[f].tolist()) for f in found]
    assert len(found) > 5 and sum(map(len, of)) == len(set(bins.tolist()))
    assert all(size[f].sum() <= substrings.PORTION_BYTES + max(size[bins == b].sum() for b in o) for f, o in zip(found, of))
    assert [f.tolist() for f in substrings.portions(size[:1], bins[:1])] == [[0]]


def test_substrings_odd_cases(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert as_lists(substrings.digests(odd).collect()) == brute_substrings(rows)
    assert substrings.digests(empty).collect() == [] and substrings.clean(empty).collect() == []
    left = substrings.clean(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert all(len(r.text) == r.n_chars for r in left.collect())


def test_substrings_mutated_copies(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcd é") for _ in range(3000))
    texts = [base]
    for _ in range(12):
        t = list(base)
        for _ in range(12):
            t[rng.randrange(len(t))] = rng.choice("xyzü")
        texts.append("".join(t)[rng.randrange(300) :])
    texts += ["a" * 700, "ab" * 300, "a" * 99, "a" * 100, base[:150] + base[:150]]
    rows = list(enumerate(texts))
    got = as_lists(substrings.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == brute_substrings(rows)


# --- near-duplicates


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            parent[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_simhash_matches_brute_force(docs, odd):
    for table in (docs, odd):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = [(r.doc_id, r.fp & 2**64 - 1, r.component_id) for r in simhash.near_duplicates(table).collect()]
        assert sorted(got, key=repr) == brute_components(rows)


@pytest.mark.parametrize("parts", [2, 3, 5])
def test_simhash_links_planted_fingerprints(spark, parts):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for x in list(fps):
        for _ in range(2):
            y = x
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << bit
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {tuple(sorted((r.a & 2**64 - 1, r.b & 2**64 - 1))) for r in simhash.links(table, parts=parts).collect()}
    want = {(int(a), int(b)) for a, b in itertools.combinations(fps, 2) if np.bitwise_count(a ^ b) <= 4}
    assert got == want


def test_dense_groups_are_walked(monkeypatch):
    monkeypatch.setattr(simhash, "LISTED", 8)
    fps = np.arange(64, dtype=np.uint64)
    a, b = simhash.links_at(np.zeros(64, np.int64), fps, np.ones(64, bool))
    assert len(a) == 63 and len(set(a.tolist()) | set(b.tolist())) == 64


def test_simhash_stage_keeps_one_of_each(odd, empty):
    got = simhash.stage(None, odd, "")
    groups = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in odd.collect()])}
    assert got.columns == odd.columns and got.count() == len(groups)
    assert simhash.stage(None, empty, "").collect() == []


def test_simhash_stage_tells_components_apart(spark):
    words = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=80))
    rows = [(None, words(1)), (None, words(2)), (None, words(3)), (7, words(4)), (7, words(5)), (7, words(5)), (8, words(4))]
    got = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows[:5]))


def brute_links(anchor, fps, link):
    """Components of rows that share an anchor and link, as sets of row numbers."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if anchor[i] == anchor[j] and sum(int(x ^ y).bit_count() for x, y in zip(fps[i], fps[j])) <= link:
            parent[find(j)] = find(i)
    return sorted(sorted(j for j in range(len(fps)) if find(j) == find(i)) for i in range(len(fps)) if find(i) == i)


@pytest.mark.parametrize("small, at_once", [(1024, 1 << 19), (1024, 16), (6, 64)])
def test_wide_fingerprints_meet_as_brute_force(monkeypatch, small, at_once):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (12, simhash.LANES)).astype(np.uint64)
    fps = base[rng.integers(0, 12, 160)]
    for row in fps:
        for bit in rng.integers(0, 256, rng.integers(0, 50)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    anchor = np.sort(rng.choice([1, 2, 2, 2, 5, 9], 160))
    a, b = simhash.meet(anchor, fps, 44)
    assert all(anchor[i] == anchor[j] and simhash._apart(fps[i], fps[j]) <= 44 for i, j in zip(a, b))
    parent = {i: {i} for i in range(160)}
    for i, j in zip(a.tolist(), b.tolist()):
        if parent[i] is not parent[j]:
            parent[i] |= parent[j]
            for k in parent[j]:
                parent[k] = parent[i]
    assert sorted({id(x): sorted(x) for x in parent.values()}.values()) == brute_links(anchor, fps, 44)


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_wide_fingerprints_lose_no_link(spark, monkeypatch, block):
    """Copies with 44 differing bits are linked, all of them, and copies with 45 are not."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2, (200, 64 * simhash.LANES), np.uint8)
    copies = base.repeat(2, axis=0)
    for i, row in enumerate(copies):
        row[rng.permutation(len(row))[: 44 + i % 2]] ^= 1
    fps = [x.tobytes() for x in np.packbits(np.concatenate([base, copies]), axis=1, bitorder="little")]
    table = spark.createDataFrame([(x,) for x in fps], "fp binary").repartition(3)
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.similar(table, len(fps)).collect()}
    assert got == {frozenset((fps[i], fps[200 + 2 * i])) for i in range(200)}


@pytest.mark.parametrize("rows", [0, 1 << 21, 1 << 25, 1 << 30])
def test_masks_cover_the_hardest_differences(rows):
    """One part has a bit less than its share differing and each other part its share: 44 in all, found under that part's masks."""
    rng, cover = np.random.default_rng(8), simhash.covers(simhash.layout(rows), 44)
    shares = [len(masks).bit_length() for _, masks in cover]
    assert sum(shares) == 45 and sorted(np.concatenate([p for p, _ in cover]).tolist()) == list(range(64 * simhash.LANES))
    for (places, masks), share in zip(cover, shares):
        for _ in range(200):
            differ = sum(1 << int(bit) for bit in rng.permutation(len(places))[: share - 1])
            assert (masks & np.uint64(differ) == 0).any()


def test_wide_fingerprint_matches_definition():
    text = "One two  three\tfour five six seven one two three four five six"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)]
    got = simhash.sketch(text)
    assert int(got[0]) == simhash.fingerprint(text, 5)
    for lane in range(1, simhash.LANES):
        mixed = []
        for h in hashes:
            z = (h + lane * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            mixed.append(z ^ z >> 31)
        assert int(got[lane]) == sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in mixed) > len(mixed))
    assert not simhash.sketch(None).any() and not simhash.sketch(" \n").any()


def test_simhash_stage_finds_pairs_at_the_similarity(spark):
    """Of pairs at 0.85 or more nearly all, below 0.5 none; unrelated documents stay."""
    rng, rows, similar, apart = random.Random(6), [], {}, set()
    for i in range(240):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for _ in range(rng.choice([1, 3, 5, 60])):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
        x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (words, other))
        jaccard = len(x & y) / len(x | y)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        if jaccard >= 0.85:
            similar[2 * i + 1] = jaccard
        elif jaccard < 0.5:
            apart.add(2 * i + 1)
    got = {r.doc_id for r in simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "").collect()}
    assert {d for d, _ in rows if d % 2 == 0} <= got and apart <= got
    assert len(similar) > 100 and len(similar.keys() - got) >= 0.93 * len(similar)


def test_layout_grows_with_rows():
    for rows in (0, 1, 10**5, 10**8, 10**11):
        parts = simhash.layout(rows)
        assert all(len(set(p.tolist())) == len(p) and p.max() < 64 * simhash.LANES for p in parts)
        assert [p.tolist() for p in parts] == [p.tolist() for p in simhash.layout(rows)]
    assert len(simhash.layout(10**5)[0]) < len(simhash.layout(10**8)[0]) < len(simhash.layout(10**11)[0])


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 10), (7, 7), (None, 3), *[(100, i) for i in range(101, 150)]]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, **{i: 100 for i in range(100, 150)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- quality rules


def test_repeat_words_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(rng.randint(0, 60))]
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
        assert quality.repeat_words(words) == len(covered)
    many = [str(i % 7000).encode() for i in range(20_000)]
    assert quality.repeat_words(many) == 20_000


def test_line_rules_and_verdict(odd, empty):
    good = "This line has a fair number of words, and it ends well.\nHere is another one that says something else entirely, too."
    assert quality.judge(good)[6]
    assert quality.judge(good + "\nHome | News | About | Contact")[8] == 1
    assert quality.judge(good + "\nAll rights reserved.")[9] == good
    assert not quality.judge("\n".join("junk" + s * 3 for s in "#*$%&|<>") + "\n" + "x### y*** z$$$ " * 3)[6]
    got = quality.clean(odd).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.doc_id in (3, 4, 5, 7))
    assert quality.clean(empty).collect() == []


# --- URL filters


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">' for h in hosts)
    rows = [
        (1, "https://a.example.com/en/7?x", link("linked.org")), (2, "http://A.example.com/en/8#y", None), (3, "http://shop.net/de/1", link("fine.io")),
        (4, "http://example.net/de/81", ""), (5, None, "<a href='/x'>"), (6, "no scheme", link("b.org")), (7, "http://b.org/es/1", link("b.org")),
        (8, "http://spam.io/", link("b.org", "b.org")), (9, "http://fine.io/de/", link("fine.io")), (10, "http://b.org/", None), (11, "x://netx/de/1", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[2] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5] == ("", "", None, "block")
    assert got[7][2:] == ("org/es/", "block") and got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[10][3] == "block" and got[11] == ("netx", "/de/1", None, "allow")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_propagation_against_power_iteration(spark):
    """300 hosts with hubs, cycles, hosts without links, and seeds of both kinds."""
    rng = np.random.default_rng(9)
    n, weights = 300, defaultdict(int)
    for a in range(n - 40):  # the last 40 link nowhere
        for b in [(a + 1) % n, 0, *rng.integers(0, n, rng.integers(0, 6)).tolist(), *(range(0, n, 3) if a == 7 else [])]:
            if a != b:
                weights[a, int(b)] += int(rng.integers(1, 4))
    seeds = [(int(h), k, float(rng.integers(1, 9))) for k in "td" for h in rng.choice(n, 25, replace=False)]
    table = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in weights.items()], "src string, dst string, n long")
    got = {(r.host, r.kind): r.value for r in url_filter.propagate(spark.createDataFrame([(f"h{h}", k, s) for h, k, s in seeds], "host string, kind string, seed double"), table, damping=0.5).collect()}
    link = np.zeros((n, n))
    for (a, b), w in weights.items():
        link[a, b] = w
    for kind, step in (("t", link), ("d", link.T)):
        step = step / np.maximum(step.sum(1, keepdims=True), 1e-300)
        seed = np.zeros(n)
        for h, k, s in seeds:
            seed[h] += s * (k == kind)
        value = np.linalg.solve(np.eye(n) - 0.5 * step.T, 0.5 * seed)
        assert max(abs(value[i] - got.get((f"h{i}", kind), 0.0)) for i in range(n)) < 1e-9 * sum(s for _, _, s in seeds)


def test_url_filter_odd_cases(spark):
    page = "<a href='//spam.org'>" * 20_000
    rows = [(1, "http://a.org/es/", None), (1, "http://a.org/es/", None), (None, None, None), (2, "http://b.io/", page), (2, "http://b.io/", page), (3, "", "")]
    clash = "page_id long, url string, html string"
    table = spark.createDataFrame([(*r, "x", "y", 1.0, 1) for r in rows], f"{clash}, host string, rule string, value double, n int").repartition(3)
    plain = spark.createDataFrame(rows, clash)
    got = sorted(map(repr, url_filter.judge(table).collect()))
    assert got == sorted(map(repr, url_filter.judge(plain).collect())) and len(got) == len(rows)


# --- stages keep columns of any name


def test_stages_keep_columns_of_their_own_names(spark, docs):
    from centra.llm.common import unused

    assert unused(["A", "_a"], "a", "b") == ["__a", "b"]
    names = ["sign", "_sign", "of", "key", "all", "rows", "at", "n", "copy", "lang_pred", "score", "spans", "__sign", "__of", "__lang", "part", "block", "c0", "a b"]
    plain = docs.limit(60).cache()
    wide = plain.select("*", *(F.concat(F.lit(f"{x}-"), F.col("doc_id").cast("string")).alias(x) for x in names)).cache()
    for stage in (language_id.stage, simhash.stage, substrings.stage, mixing.stage, bpe.stage):
        want, got = stage(spark, plain, ""), stage(spark, wide, "")
        left = want.columns
        assert sorted(map(repr, got.select(*left).collect())) == sorted(map(repr, want.select(*left).collect()))
        if stage is not bpe.stage:
            assert got.columns == wide.columns
            assert got.where(" or ".join(f"`{x}` != '{x}-' || doc_id" for x in names)).count() == 0


# --- licences


def test_expressions():
    read = lambda x, any_id=False: licenses.postfix(x.encode(), any_id)
    assert read("MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0)") == ["mit", "gpl-2.0-only", "classpath-exception-2.0", "with", "apache-2.0", "and", "or"]
    assert licenses.evaluate(read("MIT OR GPL-3.0-only AND BSD-3-Clause"))[0]
    assert not licenses.evaluate(read("(MIT OR GPL-3.0-only) AND GPL-2.0-only"))[0]
    for said in ("MIT, see below", "MIT. See", "MIT", "MIT and other terms", "MIT or so", "mit)", "MIT\nAND GPL-2.0"):
        assert read(said) == ["mit"], said
    for said in ("MIT OR", "MIT AND Foo", "MIT AND (Apache-2.0", "(MIT", "MIT/Apache-2.0", "MIT WITH anything", "MIT with anything", "(MIT OR Foo)"):
        assert read(said) == [], said
    for said in ("MIT OR", "MIT and", "MIT AND (LicenseRef-a", "a/b", "(", "MIT WITH anything"):
        assert read(said, True) == [], said
    assert read("nonsense") is None and read("") is None and read("NOASSERTION", True) is None and read("AND MIT", True) is None


def test_expressions_against_truth_tables():
    rng = random.Random(8)
    names = {"MIT": True, "GPL-2.0-only": False, "Apache-2.0": True, "MPL-2.0": False, "ISC": True, "GPL-3.0-or-later WITH Classpath-exception-2.0": False}

    def grown(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice(list(names))
        parts = [grown(depth - 1) for _ in range(rng.randint(2, 3))]
        whole = parts[0]
        for p in parts[1:]:
            whole += f" {rng.choice(('AND', 'OR'))} {p}"
        return f"({whole})" if rng.random() < 0.6 else whole

    for _ in range(400):
        said = grown(3)
        python = said
        for name in sorted(names, key=len, reverse=True):
            python = python.replace(name, str(names[name]))
        ok, found = licenses.evaluate(licenses.postfix(said.encode(), rng.random() < 0.5))
        assert ok == eval(python.replace("AND", "and").replace("OR", "or"))  # noqa: S307
        assert found == {n.split(" ")[0].lower() for n in names if n in said}


def test_tags_come_from_the_automaton():
    said = lambda x: (lambda got: (got[5], got[6], got[7], got[8]))(licenses.scan(x))
    assert said("SPDX-License-Identifier: MIT AND LicenseRef-Proprietary") == ("licenseref-proprietary,mit", 1, ["mit licenseref-proprietary and"], False)
    assert said("// SPDX-License-Identifier: (MIT OR WTFPL)\nx") == ("mit,wtfpl", 1, ["mit wtfpl or"], True)
    assert said("SPDX License Identifier: MIT") == ("mit", 1, ["mit"], True) == said("é SPDX_License_Identifier : MIT")
    for name in ("BSD-4-Clause", "LGPL-2.0-only", "OFL-1.1", "CC-BY-3.0", "DocumentRef-a:LicenseRef-b"):
        labels, *rest = said(f"SPDX-License-Identifier: {name}")
        assert name.lower() in labels.split(",") and rest == [1, [name.lower()], False]
    assert said("SPDX-License-Identifier: MIT */") == ("mit", 1, ["mit"], True)
    assert said("SPDX-License-Identifier: NOASSERTION")[1:] == said("SPDX-License-Identifier:\nword")[1:] == (0, [], None)
    assert said("licensed under the MIT and other terms")[2] == ["mit"]
    assert said("SPDX-License-Identifier: MIT AND") == ("unknown", 0.5, [], None)
    assert said("SPDX-License-Identifier: MIT OR\nlicensed under GPL-3.0")[0::3] == ("gpl-3.0,unknown", False)


def test_long_notices_take_linear_time():
    import time

    def seconds(n):
        text = "licensed under the MIT License, all rights reserved. SPDX-License-Identifier: MIT " * n
        began = time.process_time()
        got = licenses.scan(text)
        assert got[1] == n and len(got[7]) == 2 * n and got[3] - got[2] == 12 * (n - 1)
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 8 * max(seconds(4000), 0.02)


def test_license_places_against_brute_force(docs, odd, empty):
    for table in (docs, odd):
        for r, t in zip(sorted(licenses.licenses(table).collect(), key=repr), sorted(table.select("doc_id", "text").collect(), key=repr)):
            pass
        by_text = {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()): r.text or "" for r in table.collect()}
        got = {(r.doc_id): r for r in licenses.licenses(table).collect()}
        for (doc_id, _), text in by_text.items():
            words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
            at, labels = [], set()
            for phrase, label in licenses.BASE.items():
                p = phrase.encode().split()
                found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
                at += found
                labels |= {label} if found else set()
            r = got[doc_id]
            if doc_id is not None:
                assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
                assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    tagged = licenses.scan("SPDX-License-Identifier: MIT OR Apache-2.0\nrest")
    assert tagged[5] == "apache-2.0,mit" and tagged[8] and tagged[6] == 1
    assert licenses.licenses(empty).collect() == []


# --- byte pair encoding


def test_bpe_matches_tiktoken_and_round_trips(docs, odd, empty):
    encoder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe._ranks(bpe.RANKS), special_tokens={})
    for table in (docs, odd):
        texts = sorted((repr(r.doc_id), r.text or "") for r in table.collect())
        want = sorted((d, n := encoder.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts)
        got = sorted((repr(r.doc_id), r.ids) for r in bpe.encode(table).collect())
        assert got == [(d, i) for d, i, _ in want]
        said = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(table).collect())
        assert said == sorted((d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), h) for d, i, h in want)
    decoded = sorted((repr(r.doc_id), bytes(r.decoded).decode()) for r in bpe.decode(bpe.encode(odd)).collect())
    assert decoded == sorted((repr(r.doc_id), r.text or "") for r in odd.collect())
    assert bpe.encode(empty).collect() == [] and bpe.digests(empty).collect() == []


def test_quick_pretokens_equal_the_pattern():
    import regex

    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("a bZé½3²'.s\n\t\x85\xa0\x1c ll'Ðªº_-") for _ in range(rng.randint(0, 25)))
        assert bpe.pretokens(text) == regex.findall(bpe.PATTERN, text)


def test_bpe_stage_returns_the_ids(spark, odd, empty):
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.stage(spark, odd, "").collect()}
    assert got == {(r.doc_id, tuple(r.ids)) for r in bpe.encode(odd).collect()} and any(ids for _, ids in got)
    said = bpe.stage(spark, odd, "").collect()
    assert all(r.n_tokens == len(r.ids) and hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in said)
    assert bpe.stage(spark, empty, "").collect() == []


# --- nearest neighbours


def brute_neighbours(rows, k=20):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, v in good:
        if q % 20 == 0:
            near = sorted((-sum(float(a) * float(b) for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_neighbours_recall_and_order(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_neighbours([(r.vec_id, r.embedding) for r in table.collect()])
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.95
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len(near) == 20


def test_neighbours_odd_cases(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(0, 60)] + [(40, same)] + [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 0.0]), (180, [float("nan"), 1.0, 1.0]), (None, same), (200, [1.0, 2.0]), (61, [9.0, 9.0, 9.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, code string, rank int").repartition(4)
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [61, *[i for i in range(20) if i != q][: 19 - (q >= 20) + (q >= 20)]] for q in (0, 20, 40)}
    assert neighbours.nearest_neighbours(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(20, same), (3, same)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest_neighbours(one, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 3)]


def test_neighbours_are_exact_where_codes_are_poor(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16))
    x[:, 0] *= 100  # one number decides the codes of its piece, and sixteen centres tell few of its values apart
    x[1::7] = x[0::7][: len(x[1::7])]  # copies
    ids = [*range(2990), *range(20, 120, 10)]  # and ids that several vectors share
    table = spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 500 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 2990, 500):
        score = sum(x[q, d] * x[:, d] for d in range(16))
        assert got[q] == sorted(((i, s) for i, s in zip(ids, score.tolist()) if i != q), key=lambda r: (-r[1], r[0]))[:20]
    assert len(got) == 6


# --- mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in stopped)
        rest = total - sum(3 * sizes[s] for s in stopped)
        new = {s for s in names if s not in stopped and rest * weight[s] / free > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in stopped else rest * weight[s] / free for s in names}
        stopped |= new


def test_mixing_meets_targets(docs):
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0d]+", r.text)) for r in docs.collect()}
    totals = Counter()
    for d, s in source.items():
        totals[s] += size[d]
    goals = brute_targets(totals)
    first, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(5)).collect()
    assert sorted(first) == sorted(again) and len(first) == len(source)
    taken = Counter()
    for r in first:
        assert r.size == size[r.doc_id] and r.source_size == totals[source[r.doc_id]] and 0 <= r.copies <= 3
        assert r.target == pytest.approx(goals[source[r.doc_id]])
        taken[source[r.doc_id]] += r.size * r.copies
    for s, goal in goals.items():
        smallest = min(size[d] for d in source if source[d] == s)
        assert abs(taken[s] - goal) <= max(0.02 * goal, smallest)


def test_mixing_caps_and_odd_cases(spark, odd, empty):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1000, "a"), (1, "b"), (2, "c"), (3, None), (500, "a"), (0, "d")])]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[i].target for i in (1, 2, 3, 5)] == [3, 6, 9, 0] and [got[i].copies for i in (1, 2, 3)] == [3, 3, 3]
    assert got[0].target == pytest.approx(1506 - 18)
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == odd.count() and all(0 <= r.copies <= 3 for r in mixed)
    assert mixing.mix(empty).collect() == [] and mixing.stage(None, empty, "").collect() == []
    out = mixing.stage(None, odd, "")
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in mixed)


# --- language model scores


def small_net(size=10, seed=4, kind=np.float64):
    vocab = lm_score.Vocabulary({}, np.random.default_rng(seed).integers(1, 9, size))
    net = lm_score.start(vocab)
    taken = np.random.default_rng(seed).random((size, lm_score.EXPERTS)).astype(np.float32) * 9
    return vocab, lm_score.Net([a.astype(kind) for a in net.params], lm_score.distributions(vocab, taken).astype(kind))


def said(net, left, token, right):
    """log P(token | neighbours) spelled out; None stands beyond a document's ends."""
    emb, w1, b1, w2, b2 = net.params
    x = [v for t in (*left, *right) for v in emb[len(emb) - 1 if t is None else t]]
    h = [np.tanh(sum(a * w for a, w in zip(x, w1[:, j])) + b1[j]) for j in range(lm_score.HIDDEN)]
    z = np.exp([sum(a * w for a, w in zip(h, w2[:, k])) + b2[k] for k in range(lm_score.EXPERTS)])
    return np.log(sum(z[k] / z.sum() * net.dist[token, k] for k in range(lm_score.EXPERTS)))


def test_lm_gradient_matches_differences():
    vocab, net = small_net()
    near = np.array([10, 10, 3, 4, 3, 10, 10, 7, 1, 10, 10])
    p = net.params
    loss = lambda q: -lm_score.log_probabilities(lm_score.Net(q, net.dist), near).sum() / 5
    grads, take = lm_score.gradients(p, net.dist, near)
    rows, sums = lm_score._by_token(near, grads[0], vocab.size)
    whole = np.zeros_like(p[0])
    whole[rows] = sums
    for k, g in enumerate([whole, *grads[1:]]):
        for at in np.ndindex(*p[k].shape):
            if sum(at) % 7 == 0:
                up, down = [a.copy() for a in p], [a.copy() for a in p]
                up[k][at] += 1e-5
                down[k][at] -= 1e-5
                assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-7)
    live = near[2:-2] < 10
    assert np.allclose(take.sum(1), live)


def test_lm_sums_conditional_log_probabilities_that_add_to_one():
    vocab, net = small_net()
    docs = [[1, 2, 3, 4, 5], [6], [7, 8, 9, 0]]
    got = lm_score.log_probabilities(net, lm_score.stream([np.array(d) for d in docs], 10))
    want = []
    for d in docs:
        padded = [None, None, *d, None, None]
        want += [said(net, padded[i : i + 2], t, padded[i + 3 : i + 5]) for i, t in enumerate(d)] + [0.0, 0.0]
    assert np.allclose(got, want[: len(got)])
    assert sum(np.exp(said(net, [None, 4], t, [2, 9])) for t in range(10)) == pytest.approx(1)


def test_lm_words_keep_their_own_shares(spark):
    rows = [(1, "the the the the zorging " * 20), (2, "morging Morging a b c d e f g h ging."), (3, "zorging"), (4, "morging"), (5, "norging"), (6, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    coded, vocab = lm_score.read(table.where("doc_id < 3"), size=1)
    words = Counter(w for _, t in rows[:2] for w in lm_score.tokens(t))
    assert vocab.number == {b"the": 0} and vocab.counts.sum() == sum(words.values())
    # Shares of all words of one shared token add to 1, and documents hold the sums of their logs.
    shares = Counter()
    for w, n in words.items():
        if w != b"the":
            shares[lm_score.shape(w)] += n
    assert all(vocab.counts[1 + s] == n for s, n in shares.items())
    for r in coded.collect():
        own = [w for w in lm_score.tokens(dict(rows)[r.doc_id]) if w != b"the"]
        assert r.own == pytest.approx(sum(np.log(words[w] / shares[lm_score.shape(w)]) for w in own))
        assert np.frombuffer(r.ids, "<u4").tolist() == vocab.ids(lm_score.tokens(dict(rows)[r.doc_id])).tolist()


def test_lm_beats_unigrams_and_prefers_real_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    coded, vocab = lm_score.read(docs)
    counted = Counter(w for r in docs.collect() for w in lm_score.tokens(r.text))
    assert vocab.counts.sum() == sum(counted.values()) and all(vocab.counts[i] == counted[w] for w, i in vocab.number.items())
    net = lm_score.train(coded, vocab)
    total = lm_score.score(coded, net).agg(F.sum("sum_logp"), F.sum("n_tokens")).first()
    n = sum(counted.values())
    unigram = sum(c * np.log(c / n) for c in counted.values()) / n
    assert total[1] == n and total[0] / n > unigram + 0.5
    rng, better = np.random.default_rng(1), []
    for r in coded.where("n_tokens > 150").orderBy("sign").limit(150).collect():
        ids = np.frombuffer(r.ids, "<u4").astype(np.int64)
        real, mixed = (lm_score.log_probabilities(net, lm_score.stream([x], vocab.size)).sum() for x in (ids, rng.permutation(ids)))
        better.append(real > mixed)
    assert np.mean(better) >= 0.9


def test_lm_scores_do_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(lm_score, "LEAST_STEPS", 20)
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", 5000)
    monkeypatch.setattr(lm_score, "PART_WORDS", 9000)
    got = []
    for parts in (2, 7):
        coded, vocab = lm_score.read(docs.repartition(parts))
        got.append({r.doc_id: (r.n_tokens, r.sum_logp) for r in lm_score.score(coded, lm_score.train(coded, vocab)).collect()})
    assert got[0].keys() == got[1].keys()
    assert all(a[0] == got[1][d][0] and a[1] == pytest.approx(got[1][d][1], rel=1e-6, abs=1e-6) for d, a in got[0].items())


def test_lm_odd_cases(odd, empty, monkeypatch):
    monkeypatch.setattr(lm_score, "LEAST_STEPS", 10)
    coded, vocab = lm_score.read(odd)
    got = lm_score.score(coded, lm_score.train(coded, vocab)).collect()
    assert len(got) == odd.count() and all((r.mean_logp is None) == (r.n_tokens == 0) and np.isfinite(r.sum_logp) for r in got)
    coded, vocab = lm_score.read(empty)
    assert lm_score.score(coded, lm_score.train(coded, vocab)).collect() == []

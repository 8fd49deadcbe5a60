"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parcelyard.llm import byte_bpe, decontam, hpy_lm, langid, line_dedup, quality, sharding, simhash, token_files, url_filter

RANKS, PATTERN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, part int, fp long, start int"
FIND = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(3)
SYLLABLES = ["the", "ing", "on", "ter", "éa", "x", "ou", "lan", "ÅR", "st"]


def sentence(n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


TEXTS = [sentence(rng.randint(1, 60)) for _ in range(60)]
TEXTS += [TEXTS[0], TEXTS[0], None, "", " \n\t", "one", "ü", TEXTS[1] + "\n" + TEXTS[1], "a" * 30_000, ("long words " * 9_000).strip(), TEXTS[2] + " tail", "日本語 のテキスト 😀"]


def table(spark, texts=TEXTS, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "fr" if i and i % 3 == 0 else "en", "src0", 0, "k", 1, 2, 3, 4) for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jump_hash_moves_only_into_the_new_shard(spark, docs, empty):
    keys = np.arange(5000, dtype=np.uint64)
    a, b = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert set(b[a != b]) == {16} and 0.03 < (a != b).mean() < 0.09
    rows = sharding.assign_shards(docs, 3).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        t = TEXTS[r.doc_id]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
    assert sharding.assign_shards(empty, 3).count() == 0
    again = sharding.assign_shards(table(spark, ["x", "x", "y"], [None, 5, 5]), 4).collect()
    assert len(again) == 3 and len({(r.shard, r.slot) for r in again}) == 3


def test_bpe_equals_the_library(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in byte_bpe.digests(docs, RANKS, PATTERN).collect():
        t = TEXTS[r.doc_id] or ""
        ids = np.array(lib.encode_ordinary(t), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, sha(ids), sha(t.encode()))
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert all(bytes(r.decoded).decode() == (TEXTS[r.doc_id] or "") for r in back.select("doc_id", "decoded").collect())
    assert byte_bpe.digests(empty, RANKS, PATTERN).count() == 0


def test_rank_queue_merges_like_the_library():
    import tiktoken

    codec = byte_bpe.loaded(RANKS, PATTERN)
    lib = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=codec.ranks, special_tokens={})
    for alphabet in ("ab", "aaaab", "thequickbrown", "éñ中x"):
        pieces = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 2, 3, 7, 30, 3000)]
        got = codec.pieces([p.encode() for p in pieces])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib.encode_ordinary(p) for p in pieces]


def test_url_rules(spark):
    urls = {
        "https://a.example.com/en/1": "example.com/en/", "http://www.example.com/en/x?q": "www.example.com/en/", "http://example.com/de/": "com/", "http://x.net/es/": "net/es/", "http://xnet/es/": None,
        "http://NET/fr/9#": "net/fr/", "http://com": None, "no scheme": None, None: None, "http://x.org/a://b.net/es/": None, "http://x.net/" + "a" * 70_000: None, "": None,
    }
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    for i, (_, rule) in enumerate(urls.items()):
        assert got[i].rule == rule
    assert got[5].host == "net" and got[5].verdict == "block" and got[8].verdict == "allow"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_globs_equal_regexes():
    globs = ["a*b/**", "**/x?z", "*.com/**", "**ab**ab**", "?", "", "**", "a" * 70 + "*"]
    texts = ["".join(rng.choice("abxz./") for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["a" * 70, "a" * 75, "w.com/", ""]
    got = url_filter.Automaton(globs).match(texts)
    for j, g in enumerate(globs):
        parts = re.split(r"(\*\*|\*|\?)", g)
        own = re.compile("".join({"**": "[\\s\\S]*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts))
        assert [bool(x) for x in got[:, j]] == [bool(own.fullmatch(t)) for t in texts], g


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    texts = [*TEXTS, "hello <|endoftext|> world", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|> it's", "<|endoftext|"]
    at = 0
    for r in token_files.round_trip(spark, table(spark, texts), WORDS, 1).orderBy("doc_id").collect():
        ids = np.array([*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert token_files.round_trip(spark, empty, WORDS, 1).count() == 0
    nulls = token_files.round_trip(spark, table(spark, ["b", "a", "a"], [7, None, 7]), WORDS, 1).orderBy("start").collect()
    assert [r.doc_id for r in nulls] == [None, 7, 7]


def test_words_are_looked_up_once_in_a_batch(monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    texts = ["", " ", "  a  b ", "\x0b\x0ca\x1cb\x85c d e", "it's a.b, c.,. 5. x,", "\u0130 \u00c9 e\u0301 \u1e9e", "a<|endoftext|> b", "\x1f a\x00b", "a b " * 50, "on!! b'' c_ d's' 1.'s 2!' e\u0301!? x'!~ .. ''s a\u00df. <|end|> q<=\u0338", *[t or "" for t in TEXTS]]
    for most in (token_files.CACHE_WORDS, 3):
        monkeypatch.setattr(token_files, "CACHE_WORDS", most)
        words, looked = token_files.WordTokenizer(WORDS), []

        class Kept(dict):
            def get(self, w, *default):
                looked.append(w)
                return dict.get(self, w, *default)

        words.cache = Kept()
        for _ in range(2):
            looked.clear()
            for ids, t in zip(words.encode(texts, 1), texts, strict=True):
                assert ids.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 1]
        if most > 3:
            assert looked and len(looked) <= len(set(looked)) + 1  # (an empty word is looked up twice)
    assert words.encode([], 1) == []


def test_code_lengths_are_optimal_under_the_limit():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34])
    free, tight = token_files.code_lengths(counts, 16), token_files.code_lengths(counts, 4)
    assert free[0] == 0 and sum(2.0 ** -free[1:].astype(float)) == 1 and (free * counts).sum() == 220
    assert tight.max() == 4 and sum(2.0 ** -tight[1:].astype(float)) <= 1
    assert token_files.code_lengths(np.array([0, 7]))[1] == 1


def test_lm_base_counts_and_held_out_gain(docs, empty, spark):
    own = [[sentence(1) for _ in range(40)] for _ in range(2)]  # two vocabularies, so that the word before tells something
    many = [" ".join(rng.choices(own[i % 2], k=40)) for i in range(300)]
    df = table(spark, [*many, None, ""])
    rows = {r.doc_id: r for r in hpy_lm.score(df).collect()}
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    tokens = {i: [*FIND.findall(low(t)), "\n"] for i, t in enumerate([*many, None, ""])}
    c = collections.Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(x), sum(c[w] > 0 for w in x), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in x)) < 1e-6
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hpy_lm.score(empty).count() == 0


def test_first_seats_hold_all_customers():
    for n in (1, 2, 3, 50, 5000, 10**7):
        sizes = hpy_lm.first_seats(n, 0.7)
        assert sizes.sum() == n and (sizes >= 1).all() and (n < 3 or 1 < len(sizes) < n)


def seated(n, mass, discount):
    """Chances of 1 to n tables for a dish's n customers, by summing over all ways to seat them one after another."""
    ways = {1: 1.0}
    for k in range(1, n):
        after = collections.Counter()
        for t, w in ways.items():
            after[t] += w * (k - discount * t)
            after[t + 1] += w * mass(t)
        ways = after
    whole = sum(ways.values())
    return [ways.get(t, 0) / whole for t in range(1, n + 1)]


def test_reseating_samples_the_posterior():
    d, others, parent, each = 0.6, 5, 0.11, 40_000
    for n in (2, 3, 5, 9):
        sizes = np.tile(np.array([n]), each)
        seeds = np.arange(each, dtype=np.uint64)
        tables = np.ones(each, np.int64)
        for sweep in range(12):
            sizes, tables = hpy_lm.reseat(sizes, np.cumsum(tables) - tables, np.full(each, others), lambda i, t: np.full(len(i), parent), d, hpy_lm._mixed(seeds), sweep)
            assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == n).all() and (sizes >= 1).all()
        want = seated(n, lambda t: (hpy_lm.STRENGTH + d * (others + t)) * parent, d)
        got = np.bincount(tables, minlength=n + 1)[1:] / each
        assert np.abs(got - want).max() < 0.012, n


def test_reseating_of_many_customers_and_mixed_dishes():
    n = np.array([1, 2, 70, 3, 50_000, 65, 64])
    made = [hpy_lm.first_seats(int(k), 0.5) for k in n]
    sizes, tables = np.concatenate(made), np.array([len(m) for m in made])
    for sweep in range(3):
        sizes, tables = hpy_lm.reseat(sizes, np.cumsum(tables) - tables, np.full(len(n), 9), lambda i, t: np.full(len(i), 0.01), 0.5, np.arange(len(n), dtype=np.uint64), sweep)
        assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == n).all() and len(sizes) == tables.sum()


def test_every_customer_moves_in_a_sweep(monkeypatch):
    n, flat = np.array([3_000, 500, 500, 90, 9, 8, 2, 1]), lambda i, t: np.full(len(i), 1e-9)
    sweep = lambda: hpy_lm.reseat(np.ones(n.sum(), np.int64), np.cumsum(n) - n, np.zeros(len(n), np.int64), flat, 0.5, np.arange(len(n), dtype=np.uint64), 0)
    sizes, tables = sweep()
    assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == n).all()
    # nearly no table is opened, and a customer who leaves one of 3,000 tables of one closes it
    assert tables[0] < 2_000 and (tables[1:3] < 350).all() and tables[-1] == 1
    monkeypatch.setattr(hpy_lm, "TOGETHER", 2)
    assert all((a == b).all() for a, b in zip(sweep(), (sizes, tables), strict=True))


def test_reseating_of_larger_dishes_samples_the_posterior():
    d, others, parent, each, n = 0.6, 5, 0.11, 4_000, 20
    sizes, tables = np.tile(hpy_lm.first_seats(n, d), each), np.full(each, len(hpy_lm.first_seats(n, d)))
    for sweep in range(60):
        sizes, tables = hpy_lm.reseat(sizes, np.cumsum(tables) - tables, np.full(each, others), lambda i, t: np.full(len(i), parent), d, hpy_lm._mixed(np.arange(each, dtype=np.uint64)), sweep)
    want = seated(n, lambda t: (hpy_lm.STRENGTH + d * (others + t)) * parent, d)
    assert np.abs(np.bincount(tables, minlength=n + 1)[1:] / each - want).max() < 0.03


def test_customers_come_and_go():
    each, d, mass = 20_000, 0.6, lambda t: (hpy_lm.STRENGTH + 0.6 * (5 + t)) * 0.11
    seeds, others = hpy_lm._mixed(np.arange(each, dtype=np.uint64)), np.full(each, 5)
    sizes, tables = hpy_lm.come_and_go(np.ones(each, np.int64), np.ones(each, np.int64), np.full(each, 3), others, 0.11, d, seeds, 0)
    want = {1: 1.0}
    for k in (1, 2):
        after = collections.Counter()
        for t, w in want.items():
            new = mass(t) / (mass(t) + k - d * t)
            after[t] += w * (1 - new)
            after[t + 1] += w * new
        want = after
    assert all(abs((tables == t).mean() - w) < 0.015 for t, w in want.items())
    less, fewer = hpy_lm.come_and_go(np.tile([3, 1], each), np.full(each, 2), np.full(each, 3), others, 0.11, d, seeds, 1)
    assert (np.add.reduceat(less, np.cumsum(fewer) - fewer) == 3).all() and abs((fewer == 1).mean() - 0.25) < 0.015
    assert all(len(x) == 0 for x in hpy_lm.come_and_go(*[np.zeros(0, np.int64)] * 4, 0.11, d, seeds[:0], 2))


def test_tables_are_drawn_from_the_posterior():
    d, each = 0.6, 40_000
    for n, others, parent in ((1, 5, 0.11), (2, 5, 0.11), (8, 500, 0.9), (20, 5, 0.11), (300, 40, 0.01), (hpy_lm.SMALL + 200, 40, 0.01), (hpy_lm.SMALL + 200, 900, 0.05)):
        seeds = hpy_lm._mixed(np.arange(each, dtype=np.uint64))
        tables = hpy_lm.draw_tables(np.full(each, n), np.full(each, others), lambda i, t: np.full(t.shape, parent), d, seeds, 0)
        # (masses in units of n, so that ways stay within floating point)
        ways = {1: 0.0}
        for k in range(1, n):
            after = {t: w + np.log(k - d * t) for t, w in ways.items()}
            for t, w in ways.items():
                after[t + 1] = np.logaddexp(after.get(t + 1, -np.inf), w + np.log((hpy_lm.STRENGTH + d * (others + t)) * parent))
            ways = after if n <= 300 else {t: w for t, w in after.items() if w > max(after.values()) - 60}
        logs = np.array([ways.get(t, -np.inf) for t in range(1, n + 1)])
        want = np.exp(logs - logs.max())
        got = np.bincount(tables, minlength=n + 1)[1:] / each
        assert np.abs(got - want / want.sum()).max() < 0.012, n


def test_ways_of_many_customers_equal_the_rule_of_one_more():
    for d in (0.05, 0.5, 0.78, 0.95):
        row, n = hpy_lm._ways(d)[-1, : hpy_lm.TERMS], hpy_lm.SMALL
        for n in range(hpy_lm.SMALL, hpy_lm.SMALL + 3_000):
            row = hpy_lm._next_ways(row, n, d)
        got = hpy_lm._ways_of_many(np.array([n + 1]), d)[0] + math.lgamma(n + 1)
        some = np.isfinite(got)
        assert some.any() and np.abs(got - row)[some].max() < 1e-5, d


def test_hot_dishes_of_few_tables_take_no_steps(monkeypatch):
    monkeypatch.setattr(hpy_lm, "_next_ways", None)  # (would be called for each customer)
    monkeypatch.setattr(hpy_lm, "_ways", lambda discount: None)
    n = np.array([10**9, 30_000, 5_000])
    tables = np.array([hpy_lm.draw_tables(n, np.full(3, 1_000_000), lambda i, t: np.full(t.shape, 1e-6), 0.6, np.arange(3, dtype=np.uint64), sweep) for sweep in range(2_000)])
    # one and a number that is nearly Poisson of the mean mass / discount
    assert np.abs(tables.mean(axis=0) - 2).max() < 0.12


def plain_model(train, words, sweeps, d, dw):
    """A sequential Gibbs sampler of the two levels, a customer at a time; the chance of each (context, word), averaged."""
    own = random.Random(5)
    strength, known = hpy_lm.STRENGTH, len(words)
    inner, outer, total, count = collections.defaultdict(list), collections.defaultdict(list), 0, 0
    tables_of, seen = collections.Counter(), collections.Counter()

    def pick(sizes, new, discount):
        x = own.random() * (sum(s - discount for s in sizes) + new)
        for i, s in enumerate(sizes):
            x -= s - discount
            if x < 0:
                return i
        return len(sizes)

    def root(w):
        return (sum(outer[w]) - dw * len(outer[w]) + (strength + dw * total) / (known + 1)) / (strength + count)

    def sit(sizes, i):
        sizes.append(1) if i == len(sizes) else sizes.__setitem__(i, sizes[i] + 1)

    def leave(sizes):
        i = own.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    kept = collections.Counter()
    for sweep in range(sweeps):
        for u, w in train:
            sizes = inner[u, w]
            if sweep and leave(sizes):
                tables_of[u] -= 1
                count -= 1
                total -= leave(outer[w])
            i = pick(sizes, (strength + d * tables_of[u]) * root(w), d)
            if i == len(sizes):
                tables_of[u] += 1
                j = pick(outer[w], (strength + dw * total) / (known + 1), dw)
                total += j == len(outer[w])
                sit(outer[w], j)
                count += 1
            sit(sizes, i)
            seen[u] += not sweep
        if sweep >= sweeps // 2:
            for u in words:
                for w in words:
                    s = inner[u, w]
                    kept[u, w] += (sum(s) - d * len(s) + (strength + d * tables_of[u]) * root(w)) / (strength + seen[u]) / (sweeps - sweeps // 2)
    return kept


def test_lm_agrees_with_a_plain_sampler(spark, monkeypatch):
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (1 + (i * 7 + k) % 12) for i in range(12)], k=25)) for k in range(80)]
    monkeypatch.setattr(hpy_lm, "_discount", lambda one, two: 0.5)
    got = {r.doc_id: r for r in hpy_lm.score(table(spark, texts)).collect()}
    train = []
    for i, t in enumerate(texts):
        w = [*t.split(), "\n"]
        if not got[i].held_out:
            train += list(zip(["\n", *w], w, strict=False))
    chance = plain_model(train, [*vocabulary, "\n"], 40, 0.5, 0.5)
    for i, t in enumerate(texts):
        w = [*t.split(), "\n"]
        want = sum(np.log10(chance[p]) for p in zip(["\n", *w], w, strict=False))
        assert abs(got[i].score - want) < 0.02 * abs(want)


def test_lm_scores_do_not_depend_on_the_cut(spark, monkeypatch):
    texts = [*TEXTS, "Only here", "only HERE"]
    ids = [*range(len(TEXTS)), None, 7]
    rows = lambda df: sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in hpy_lm.score(df).collect())
    want = rows(table(spark, texts, ids).coalesce(1))
    assert len(want) == len(texts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(hpy_lm, "MATRIX", 64)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert rows(table(spark, texts, ids).repartition(5)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lm_gathers_from_held_out_texts_alone(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = hpy_lm.score(table(spark, ["a b"] * len(ids), ids)).collect()
    assert {(r.n_known, r.train_tokens, r.score, r.base_score) for r in got} == {(0, 0, 0.0, 0.0)}


def brute_groups(x, most=3):
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in range(i):
            if (x[i] ^ x[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(x))]


def test_simhash_groups(spark, docs, empty, monkeypatch):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    x = [int(got[i].fingerprint, 16) for i in range(len(TEXTS))]
    assert [got[i].component_id for i in range(len(TEXTS))] == brute_groups(x) and x[62] == x[63] == x[64] == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(table(spark, ["x", "x", None], [None, 4, 4])).count() == 3


@pytest.mark.parametrize(("small", "tile"), [(1024, 4096), (2, 4096), (2, 2)])
def test_links_reach_all_within_three_bits(spark, monkeypatch, small, tile):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    base = [rng.getrandbits(64) for _ in range(6)]
    x = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    want = brute_groups(x)
    groups = collections.defaultdict(set)
    for v, g in zip(signed, want, strict=True):
        groups[g].add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_flip_lookup_equals_comparison(monkeypatch):
    x = np.array(sorted({rng.getrandbits(12) for _ in range(300)}), np.uint64)
    plain = simhash._forest(x)
    monkeypatch.setattr(simhash, "TILE", 1)
    assert {*zip(*plain, strict=True)} == {*zip(*simhash._forest(x), strict=True)}


def test_fingerprint_equals_counting():
    import xxhash

    for t in (*TEXTS[:20], "x y", "a b c d", "word " * 1000, sentence(300_000)):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("leaders", "chunk"), [(2, 4096), (0, 3)])
def test_similar_groups_equal_brute_force(spark, monkeypatch, leaders, chunk):
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    texts = [sentence(rng.randint(60, 200)) for _ in range(8)]
    for base in texts[:8]:
        for _ in range(8):
            w = base.split()
            for i in rng.sample(range(len(w)), rng.randint(1, max(1, len(w) // 60))):
                w[i] = sentence(1)
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_similar_groups_find_near_copies(spark):
    base = [sentence(120) for _ in range(12)]
    near = [" ".join(w if i != 60 else "changed" for i, w in enumerate(t.split())) for t in base]
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(table(spark, [*base, *near, base[0], None, ""])).collect()}
    assert all(got[12 + i] == i for i in range(12)) and got[24] == 0 and got[26] == 25 and len({got[i] for i in range(12)}) == 12


def test_quality_equals_brute_force(docs, empty):
    for r in quality.rate(docs).collect():
        t = TEXTS[r.doc_id] or ""
        w = FIND.findall(t)
        runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {i + j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if FIND.search(x)]
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed)
        assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert not (r.base_failed and r.kept)
    assert quality.rate(empty).count() == 0


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) or 1)
        s[i : i + rng.randint(0, 1)] = [] if rng.random() < 0.3 else [rng.choice("xyzé")]
    return "".join(s)


def test_banded_distance(spark):
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randint(0, 9))),) for _ in range(200)]
    pairs = [(a, edited(a, rng.randint(0, 3)) if a else "b") for (a,) in pairs]
    chars = lambda c: line_dedup._characters(F.col(c))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", chars("a").alias("x"), chars("b").alias("y"))
    for r in df.select("a", "b", line_dedup.banded_distance(F.col("x"), F.col("y")).alias("d")).collect():
        d = levenshtein(r.a, r.b)
        assert r.d == (d if d <= 2 else None)


@pytest.mark.parametrize("large", [200, 3])
def test_line_links_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(line_dedup, "LARGE", large)
    base = [sentence(8)[:60] for _ in range(8)]
    lines = sorted({b for b in base} | {edited(b, rng.randint(1, 3)) for b in base for _ in range(8)})
    df = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    got = {(r.a, r.b) for r in line_dedup.links(df).collect()}
    most = lambda a, b: 2 if min(len(a), len(b)) >= 30 else 1 if min(len(a), len(b)) >= 15 else 0
    assert got == {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and levenshtein(a, b) <= most(a, b)}


def test_line_classes_and_texts(spark, docs, empty):
    texts = ["a common line of more than thirty chars\nown line", " a common line of more than thirty chars\n\nother", "a common line of more than thirty char5", None, "", "own line\nown line"]
    rows = {(r.doc_id, r.line_no): r for r in line_dedup.line_classes(table(spark, texts)).collect()}
    assert rows[0, 0].kept and not rows[1, 0].kept and (rows[2, 0].class_doc, rows[2, 0].class_line, rows[2, 0].n_links) == (0, 0, 1)
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(table(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "\nother", 3: None, 4: ""}
    assert line_dedup.line_classes(empty).count() == 0 and line_dedup.without_repeated_lines(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = [sentence(n) + ". " + sentence(6) for n in (6, 12, 30, 50)]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (None, "x")], "item_id long, text string")
    texts = [sentence(300) + " " + items[1].upper() + " " + sentence(300), items[3], sentence(40), None, "", " ".join(items), sentence(2000) + " " + items[2]]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(table(spark, texts), bench).collect()}
    assert got == {(0, 1), (1, 3), (5, 0), (5, 1), (5, 2), (5, 3), (6, 2)}
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(table(spark, texts), bench.limit(0)).count() == 0


def test_more_indexes_give_the_same(spark, monkeypatch):
    items = [sentence(15) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = table(spark, [sentence(20) + " " + t + " " + sentence(20) for t in items])
    one = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    monkeypatch.setattr(decontam, "INDEX_CHARS", 500)
    assert one == {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} and len(one) >= 20


def test_languages(spark, empty):
    en, de = "the quick brown fox and the lazy dog went over there with them".split(), "der schnelle braune fuchs und der faule hund gingen über die straße".split()
    texts = [" ".join(rng.choices(en if i % 2 else de, k=30)) for i in range(80)] + [None, "", "123 !?", "the dog"]
    rows = [(i, t, "en" if i % 2 else "de", "s", 0, "x", 0.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.held_out_languages(df).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(80)) and [got[i].lang_pred for i in (80, 81, 82, 83)] == ["und", "und", "und", "en"]
    told = langid.identify(df, langid.sample_languages(df))
    assert told.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"] and told.where("lang_pred = 'x'").isEmpty()
    # repeated rows and a null key are judged like others; a dirty label of few rows is not learned beyond the bound
    odd = df.unionByName(df.limit(3)).unionByName(df.limit(1).selectExpr("cast(null as long) doc_id", "text", "'??' lang", "source", "n_chars", "lang_pred", "score"))
    assert langid.held_out_languages(odd).count() == 88 and set(langid.sample_languages(odd, langs=2)) == {"de", "en"}
    assert all(0 <= r.score <= 1 for r in got.values()) and langid.held_out_languages(empty).count() == 0


def test_phrases_equal_brute_force():
    parser = langid.Parser({"a": ["abracadabra banana"], "b": ["xyz yxz", "zzyx banyan"]})
    long = "".join(rng.choice("abracdnxyz ") for _ in range(3000))
    whole = "abracadabra banana" * 200 + "xyz yxz zzyx banyan" * 200
    for text, piece in (("abrabananxyz", 1024), ("zzz", 1024), ("banana banyan q", 1024), ("é", 1024), (long, 1024), (long, 7), (whole, 7), (whole, 3), (whole[:40], 1)):
        langid.PIECE = piece
        s = parser.symbols(text).tolist()
        for j, sample in enumerate(("abracadabra banana", "xyz yxz zzyx banyan")):
            own = parser.symbols(sample).tolist()
            at, n = 0, 0
            while at < len(s):
                k = 1
                while at + k < len(s) and any(own[i : i + k + 1] == s[at : at + k + 1] for i in range(len(own) - k)):
                    k += 1
                if not any(own[i] == s[at] for i in range(len(own))):
                    k = 1
                at, n = at + k, n + 1
            got = parser.phrases([np.array(s, np.uint16), np.zeros(0, np.uint16), np.array(s[:5], np.uint16)])
            assert got[0, j] == n and got[1, j] == 0
    langid.PIECE = 1024


def test_decontamination_of_parted_halves(spark):
    ask, tell = [sentence(n) + "." for n in (7, 11, 16, 50)], [sentence(n) + "." for n in (6, 4, 1, 5)]
    bench = spark.createDataFrame([(i, q + " " + a) for i, (q, a) in enumerate(zip(ask, tell, strict=True))], "item_id long, text string")
    parted = [sentence(lead) + " " + q + " Well, so the Answer is: " + a + " " + sentence(90) for lead in (1, 37, 70) for q, a in zip(ask, tell, strict=True)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(table(spark, parted), bench).collect()}
    assert got == {(i, i % 4) for i in range(12)}
    # a question whose answer is another's is no leak unless it makes most of the item
    other = [sentence(20) + " " + ask[0] + " " + tell[1] + " " + sentence(20)]
    assert decontam.leaks(table(spark, other), bench).count() == 0


def test_part_indexes_score_as_one(spark, monkeypatch):
    # common words in some items only: counts and lengths of a part differ from those of all
    items = [" ".join(["the"] * (i % 3) + [sentence(4 + i)] + ["on"] * (i % 2)) for i in range(24)]
    bench = spark.createDataFrame([(2**62 + i, t) for i, t in enumerate(items)], "item_id long, text string")
    cut = [" ".join(w for k, w in enumerate(t.split()) if k % 9 != 8) for t in items]
    df = table(spark, [sentence(20) + " " + t + " " + sentence(20) for t in items + cut])
    one = sorted(decontam.leaks(df, bench).collect())
    monkeypatch.setattr(decontam, "INDEX_CHARS", 200)
    # rows equal in full, so the scores too
    assert one == sorted(decontam.leaks(df, bench).collect()) and {r.item_id - 2**62 for r in one} == set(range(24))


def test_similar_groups_of_truncated_and_appended_copies(spark):
    shingled = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    texts = []
    for i in range(120):
        n = 60 + 5 * i
        words = [f"w{i}x{k}" for k in range(n)]
        rest = [f"v{i}x{k}" for k in range(n)] if i % 2 else []
        # as much cut or added as 0.8 bears
        part = [" ".join(words[:k]) for k in range(n, 5, -1)] if not rest else [" ".join(words + rest[:k]) for k in range(n)]
        whole = shingled(part[0])
        similar = [t for t in part if len(whole & shingled(t)) >= 0.8 * len(whole | shingled(t))]
        texts += [part[0], similar[-1]]
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_rows_with_repeated_and_null_keys(spark):
    line = "a line that is long enough to be compared with others"
    rows = [(0, line, "k0"), (1, line + "\nunique one", "k1"), (1, "unique two\nunique three", "k2"), (None, line + "\nunique four", "k3"), (None, "unique five", "k4"), (None, "unique five", "k4"), (None, None, "k5"), (7, "", "k6")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _key string, _drop int, gone int")
    got = line_dedup.without_repeated_lines(df)
    assert got.columns == df.columns
    left = sorted(((r.doc_id, r.text, r._key) for r in got.collect()), key=repr)
    # (null keys come first, so that the line stays there)
    assert left == sorted([(1, "unique one", "k1"), (1, "unique two\nunique three", "k2"), (None, line + "\nunique four", "k3"), (None, "unique five", "k4"), (None, None, "k5"), (7, "", "k6")], key=repr)
    assert sum(line in (t or "") for _, t, _ in left) == 1


def test_one_of_each_with_repeated_and_null_keys(spark):
    a, b, c = sentence(80), sentence(80), sentence(80)
    near = " ".join(w if i != 40 else "changed" for i, w in enumerate(a.split()))
    rows = [(0, b), (1, a), (1, b), (1, a), (2, near), (None, c), (None, c), (None, a), (3, None), (3, ""), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x", "y", True) for r in rows], "doc_id long, text string, h int, id string, row string, kept boolean")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr) == sorted([(0, b), (1, a), (None, c), (3, "")], key=repr)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_similar_groups_of_many_unlike_copies(spark):
    # all share most of their shingles with some, few are similar: what leaders leave open must be found
    base = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(150):
        own = random.Random(i)
        share = own.random() * 0.2
        texts.append(" ".join(w if own.random() > share else f"x{own.randrange(10**6)}" for w in base))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    got = {r.doc_id: r.group_id for r in simhash.similar_groups(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == root and 1 < len(set(root)) < 150


@pytest.mark.parametrize("n", [1200])
def test_lines_of_a_large_clique(spark, n):
    # lines that differ in their figures only, far more than LARGE under every other key
    lines = [f"Item {i:04d} of the catalogue of spring and summer goods" for i in range(n)]
    found = line_dedup.links(spark.createDataFrame(list(enumerate(lines)), "h long, line string")).toPandas()
    figures = np.array([[int(c) for c in f"{i:04d}"] for i in range(n)])
    got = set(zip(found["a"], found["b"], strict=True))
    assert len(got) == len(found)
    for i in range(0, n, 97):
        near = np.flatnonzero((figures != figures[i]).sum(1) <= 2)
        moved = {j for j in range(n) if j not in set(near) and levenshtein(f"{i:04d}", f"{j:04d}") <= 2}
        assert {b for a, b in got if a == i} | {a for a, b in got if b == i} == (set(near) | moved) - {i}


def test_short_lines_may_differ_by_one(spark):
    lines = ["fifteen letters", "fifteen lettera", "fifteen letterxy", "fourteen chars", "fourteen charz", "x" * 29, "x" * 28 + "yy", "y" + "x" * 30, "z" + "x" * 29 + "z"]
    got = {(r.a, r.b) for r in line_dedup.links(spark.createDataFrame(list(enumerate(lines)), "h long, line string")).collect()}
    most = lambda a, b: 2 if min(len(a), len(b)) >= 30 else 1 if min(len(a), len(b)) >= 15 else 0
    assert got == {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and levenshtein(a, b) <= most(a, b)} and got


def test_jump_hash_equals_the_published_loop():
    for key in [0, 1, 7, 2**63, 2**64 - 1, *(rng.getrandbits(64) for _ in range(200))]:
        for shards in (1, 2, 16, 17, 1000):
            k, b, j = key, -1, 0
            while j < shards:
                b = j
                k = (k * 2862933555777941757 + 1) % 2**64
                j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
            assert sharding.jump_hash(np.array([key], np.uint64), shards)[0] == b


def test_quality_verdicts_equal_brute_force(spark):
    texts = [t for t in TEXTS if t is not None and len(t) < 5000] + ["\n".join([sentence(6)] * 3 + [sentence(9) for _ in range(8)]), sentence(40) + " " + " ".join(["##"] * 9), " ".join(rng.choices([sentence(4) for _ in range(6)], k=12))]
    for r in quality.rate(table(spark, texts)).collect():
        w = FIND.findall(texts[r.doc_id])
        total = max(1, sum(map(len, w)))
        bad = r.base_failed
        for k, most in quality.MOST_REPEATED.items():
            seen, inside = set(), set()
            for i in range(len(w) - k + 1):
                run = tuple(w[i : i + k])
                if run in seen:
                    inside.update(range(i, i + k))
                seen.add(run)
            share = sum(len(w[i]) for i in inside) / total
            assert r[f"repeat_{k}"] == pytest.approx(share)
            bad |= share > most
        lines, again = set(), 0
        for x in texts[r.doc_id].split("\n"):
            if FIND.search(x):
                again += sum(map(len, FIND.findall(x))) if x in lines else 0
                lines.add(x)
        bad |= again > quality.MOST_LINE_CHARS * sum(map(len, w)) or len(re.findall(r"[#*$%&|<>]", texts[r.doc_id])) > quality.MOST_SYMBOLS * len(w)
        assert r.kept == (not bad)

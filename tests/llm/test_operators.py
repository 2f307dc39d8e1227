"""Each operator against a brute-force version, and on odd rows."""

import datetime
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    lines,
    linear,
    mixing,
    pii,
    quality,
    repetition,
    resemblance,
    shards,
    simhash,
    text,
    toxicity,
    urls,
)
from tidemark.llm import queries as llm_queries
from tidemark.llm.ngrams import features

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that the operators use inside
    "shard int, slot int, virtual_slot int, key long, size long, before long, line long, fp long, "
    "n int, low int, leaf int, epochs int, cut int, of string, id long, matches int, _overlaps int"
)
OF = [c.split()[0] for c in SCHEMA.split(", ")].index("of")
EXTRA = SCHEMA.count(",") + 1 - 5


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, source)"""
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *[7] * EXTRA)
            for r in rows
        ]
        full = [r[:OF] + ("x",) + r[OF + 1 :] for r in full]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    """Null and empty texts, blanks, a very long text, repeated rows, null ids and sources."""
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(120_000))
    return make_docs(
        [
            (1, None),
            (2, ""),
            (3, " \n\t \n"),
            (4, long),
            (5, "one two three four five six seven eight nine ten", None),
            (5, "one two three four five six seven eight nine ten", None),
            (None, "a row without an id and some words in it, ten", "z"),
            (None, None, "z"),
            (8, "ä ö ü ß", "z"),
        ]
    )


BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def words(t):
    return BLANKS.findall(t or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# words


def test_word_count_and_tokens(odd):
    got = odd.select(text.word_count(F.col("text")), "text").collect()
    assert [r[0] for r in got] == [len(words(r[1])) for r in got]
    texts = ["a b a", "", " x\ny\x0bx ", "\n", "b"]
    t = text.tokenize([x.encode() for x in texts])
    named = {}
    flat = [w for x in texts for w in words(x)]
    assert len(t.hash) == len(flat)
    for h, w in zip(t.hash, flat):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


# 1 pseudonyms

CASES = [
    ("card", "4111 1111 1111 1111"),
    ("card", "5500-0000-0000-0004"),
    ("ip", "192.168.7.254"),
    ("ssn", "123-45-6789"),
    ("phone", "+1 (017) 555-7713"),
    ("phone", "(487) 555-7209"),
    ("iban", "DE89 3704 0044 0532 0130 00"),
    ("date", "2024-02-29"),
    ("date", "3/7/1999"),
    ("date", "31.12.2020"),
    ("date", "25/12/2021"),
]
BAD = ["4111 1111 1111 1112", "300.1.1.1", "000-12-3456", "2023-02-29", "DE88 3704 0044 0532 0130 00", "40/40/2020"]


def luhn_ok(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_formats_and_go_back(make_docs):
    rows = [(i, f"See {v}, and again {v}.") for i, (_, v) in enumerate(CASES)]
    docs = make_docs(rows)
    out = pii.pseudonymised(docs, "k")
    assert out.columns == docs.columns + ["pii_dates", "pii_numbers"]
    for i, t, dates, numbers in by_id(out, "doc_id", "text", "pii_dates", "pii_numbers"):
        kind, value = CASES[i]
        first, second = re.fullmatch(r"See (.*), and again (.*)\.", t).groups()
        assert first == second != value
        shape = lambda v: re.sub(r"\d", "9", v)
        if kind not in ("ip", "date"):
            assert shape(first) == shape(value)
        assert (dates, numbers) == ((2, 0) if kind == "date" else (0, 2))
        if kind == "card":
            assert luhn_ok(first)
        if kind == "iban":
            plain = first.replace(" ", "")
            digits = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
            assert int(digits) % 97 == 1 and plain[:2] == "DE"
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in first.split("."))
        if value.startswith("2024"):
            datetime.date.fromisoformat(first)
    back = pii.pseudonymised(out.select(docs.columns), "k", reveal=True)
    plain = [(i, t.replace("3/7/", "03/07/")) for i, t in rows[:10]]  # the day comes back, padded
    assert by_id(back.filter("doc_id not in (10)"), "doc_id", "text") == sorted(plain)
    other = pii.pseudonymised(docs, "another")
    assert set(by_id(other, "text")).isdisjoint(by_id(out, "text"))


def test_pseudonyms_leave_other_things(make_docs, odd):
    rows = [(i, f"x {v} y") for i, v in enumerate([*BAD, "12345", "v1.2.3", "no digits", ""])]
    assert by_id(pii.pseudonymised(make_docs(rows), "k"), "doc_id", "text") == sorted(rows)
    assert by_id(pii.pseudonymised(odd, "k"), "doc_id", "text") == by_id(odd, "doc_id", "text")
    assert pii.pseudonymised(odd.limit(0), "k").count() == 0


def feistel_by_hand(x, y, a, b, tweak, key):
    for r in range(pii.ROUNDS):
        digest = hashlib.sha256(f"{key}:{tweak}:{r}:{y}".encode()).hexdigest()[:15]
        x, y, a, b = y, (x + int(digest, 16)) % a, b, a
    return x, y


def test_feistel_is_a_permutation(spark):
    rows = spark.range(15 * 7).select((F.col("id") % 15).alias("x"), F.expr("id div 15").alias("y"))
    lit = F.lit
    done = pii.feistel(F.col("x"), F.col("y"), lit(15), lit(7), lit("t"), "k", False)
    got = {(r.x, r.y): (r.d.x, r.d.y) for r in rows.select("x", "y", done.alias("d")).collect()}
    assert len(set(got.values())) == 105
    assert got == {p: feistel_by_hand(*p, 15, 7, "t", "k") for p in got}


# 2 shards


def test_slots_and_maps(odd, make_docs, tmp_path, spark):
    docs = make_docs([(i, prose(i, 5 + i % 90)) for i in range(600)])
    sizes = shards.slot_bytes(docs)
    first = shards.first_map(sizes, 24)
    loads = first.loads(sizes)
    assert loads.sum() == sum(len(r.text.encode()) + 8 for r in docs.collect())
    assert loads.max() - loads.min() <= sizes.max()
    out = shards.sharded(docs, first)
    got = out.groupBy("shard").agg(F.sum(shards.record_bytes(F.col("text")))).collect()
    assert dict(map(tuple, got)) == {i: x for i, x in enumerate(loads)}
    assert set(out.columns) == set(docs.columns)
    more = shards.grown(first, sizes)
    moved = more.shard != first.shard
    assert set(more.shard[moved]) == {24} and more.version == 2
    skewed = sizes * (1 + 9 * (first.shard == 3))
    edited = shards.rebalanced(first, skewed)
    assert edited.version == 2 and edited.loads(skewed).max() < 0.5 * first.loads(skewed).max()
    assert shards.rebalanced(edited, skewed, 24.0) is edited
    for m in (first, edited):
        m.save(spark, str(tmp_path / "maps"))
    loaded = shards.SlotMap.load(spark, str(tmp_path / "maps"))
    assert loaded.version == 2 and (loaded.shard == edited.shard).all()
    assert shards.sharded(odd, first).count() == odd.count()
    assert shards.slot_bytes(odd.limit(0)).sum() == 0


def test_current_slot_map(spark, tmp_path):
    """The newest stored version is used as long as it fits; every edit is stored beside it."""
    folder, rng = str(tmp_path / "maps"), np.random.default_rng(5)
    sizes = rng.integers(1, 1000, shards.SLOTS)
    use = lambda bytes_of, n=24: shards.current_map(spark, folder, bytes_of, n)
    assert shards.SlotMap.versions(spark, folder) == []
    first = use(sizes)
    assert first.version == 1 and (first.shard == shards.first_map(sizes, 24).shard).all()
    assert (use(sizes).shard == first.shard).all() and shards.SlotMap.versions(spark, folder) == [1]
    skewed = sizes * (1 + 9 * (first.shard == 3))
    edited = use(skewed)
    moved = edited.shard != first.shard
    assert edited.version == 2 and set(first.shard[moved]) == {3}
    assert edited.loads(skewed).max() <= 1.01 * skewed.sum() / 24 + skewed[moved].max()
    more = use(skewed, 25)
    assert more.version > 2 and more.shards == 25 and (more.loads(skewed) > 0).all()
    assert use(skewed, 25).version == more.version
    with pytest.raises(ValueError):
        use(skewed, 24)
    assert (shards.SlotMap.load(spark, folder, 1).shard == first.shard).all()
    # A version whose writing broke off does not count.
    (tmp_path / "maps" / "version=99").mkdir()
    assert use(skewed, 25).version == more.version


def test_op2_by_hand(spark, tmp_path):
    rows = [(i, "ü" * (i % 90) if i % 7 else None) for i in range(3000)] + [(5, "again"), (None, "x"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = llm_queries.op2_virtual_slots(spark, str(tmp_path)).collect()
    sized = sorted((i is None, i or 0, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sized
    loads = np.zeros(24)
    for k in range(24):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        loads[k] = sum(r.size for r in own)
    largest = max(Counter(sum([[r.virtual_slot] * r.size for r in got], [])).values())
    assert loads.max() - loads.min() <= largest
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)


# 3 repetition


def repeats_by_hand(t, least, over):
    w = words(t)
    inside, longest = set(), 0
    for p in range(len(w)):
        for q in range(len(w)):
            k = 0
            while p != q and max(p, q) + k < len(w) and w[p + k] == w[q + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                inside.update(range(p, p + k))
    return len(inside), longest


@pytest.mark.parametrize("seed", range(4))
def test_repeats(seed):
    r = random.Random(seed)
    texts = [prose(seed * 10 + i, r.randrange(0, 60), r.choice([2, 5, 50])) for i in range(12)]
    texts += ["", " \n", "x " * 40, texts[0]]
    got = repetition.measured([t.encode() for t in texts], repetition.Rules(4))
    for t, row in zip(texts, got.itertuples()):
        assert (row.covered_words, row.longest_repeat) == repeats_by_hand(t, 4, 0)
        assert row.n_repeat_words == repeats_by_hand(t, 3, 0)[0]
        assert sum(s["end"] - s["start"] for s in row.spans) == row.covered_words
        assert row.n_words == len(words(t))


def test_repetition_verdict(make_docs, odd):
    copied = prose(1, 70, 9999)
    docs = make_docs([(1, prose(2, 300, 9999)), (2, f"{copied}\n{prose(3, 500, 9999)}\n{copied}")])
    out = repetition.judged(docs)
    assert by_id(out, "doc_id", "repetition_kept") == [(1, True), (2, False)]
    assert repetition.judged(odd).count() == odd.count()
    assert repetition.judged(odd.limit(0)).count() == 0


# 4 near copies


def print_by_hand(t, k):
    w = [x.encode() for x in words("".join(c.lower() if c.isascii() else c for c in t or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, ids, bound):
    group = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bound and group[i] != group[j]:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    return [min((ids[j] for j in range(len(ids)) if group[j] == g), default=None) for g in group]


def test_simhash_components(make_docs, odd, monkeypatch):
    r = random.Random(5)
    base = [prose(i, 120, 5000) for i in range(12)]
    rows = []
    for i in range(90):
        w = base[i % 12].split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = f"n{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, "Upper CASE"), (203, "upper case")]
    docs = make_docs(rows)
    monkeypatch.setattr(simhash, "SHARD", 8)  # several shards
    monkeypatch.setattr(simhash, "LEAF", 3)
    prints = [print_by_hand(t, 3) for _, t in rows]
    want = components_by_hand(prints, [i for i, _ in rows], 2)
    got = by_id(simhash.clustered(docs), "doc_id", "fp", "component_id")
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    expected = [(i, signed(p), c) for (i, _), p, c in zip(rows, prints, want)]
    assert got == sorted(expected, key=repr)
    assert simhash.clustered(odd.limit(0)).count() == 0


def test_vp_routing_loses_no_pair():
    r = np.random.default_rng(1)
    seeds = r.integers(0, 1 << 63, 60, np.uint64)
    points = np.unique(np.concatenate([seeds, seeds ^ np.uint64(5), seeds ^ np.uint64(1 << 40)]))
    root, leaves = simhash.routing_tree(points[::2], 8)
    at, leaf, home = simhash.route(root, points, 2)
    assert Counter(at[home]) == Counter(range(len(points))) and leaves > 4
    reach = {(i, x) for i, x in zip(at, leaf)}
    homes = dict(zip(at[home], leaf[home]))
    for i, j in itertools.combinations(range(len(points)), 2):
        if int(points[i] ^ points[j]).bit_count() <= 2:
            assert (i, homes[j]) in reach and (j, homes[i]) in reach


def test_star_contraction(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(99, 60)]
    pairs = [(max(p), min(p)) for p in chain]
    got = dict(simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {99: 60}
    none = spark.createDataFrame([], "u long, v long")
    assert simhash.components(none).count() == 0


def test_resemblance(make_docs, odd, monkeypatch):
    rows, r = [], random.Random(3)
    for i in range(30):
        w = prose(i, 300, 9999).split()
        rows.append((10 * i, " ".join(w)))
        near = list(w)
        for k in r.sample(range(len(w)), 4):  # about 20 of 300 shingles
            near[k] = f"n{k}"
        rows.append((10 * i + 1, " ".join(near)))
        rows.append((10 * i + 2, " ".join(w).upper()))
    for block in (1 << 13, 2):  # the second deals every shard in blocks
        monkeypatch.setattr(resemblance, "SHARD", block)
        got = dict(by_id(resemblance.clustered(make_docs(rows)), "doc_id", "component_id"))
        assert got == {i: i - i % 10 for i, _ in rows}
    kept = resemblance.without_copies(odd)
    assert [r[0] for r in by_id(kept, "doc_id")] == [1, 4, 5, 8, None] and kept.columns == odd.columns
    assert resemblance.without_copies(odd.filter("false")).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_copies_go_by_their_own_text(make_docs, monkeypatch, broadcast):
    """Rows that share an id, or have none, stay or go each by itself; of equal rows one stays."""
    if not broadcast:
        monkeypatch.setattr(resemblance, "MOST_BROADCAST", -1)
    a, b, c, d, e = (prose(i, 60, 9999) for i in range(50, 55))
    rows = [(0, a), (1, a), (1, b), (1, b), (2, c), (None, c.upper()), (None, d), (None, d), (None, d + " x"), (None, e)]
    kept = by_id(resemblance.without_copies(make_docs(rows)), "doc_id", "text")
    sets = [t for _, t in kept]
    assert kept[:3] == sorted([(0, a), (1, b), (2, c)], key=repr)
    assert len(kept) == 5 and e in sets and len({d, d + " x"} & set(sets)) == 1


def test_short_texts_are_compared_exactly(make_docs, monkeypatch):
    """Groups are the components of the pairs that really are 0.8 alike."""
    r, texts = random.Random(8), {}
    for family in range(60):
        w = [f"f{family}w{k}" for k in range(r.randrange(5, 34))]
        texts[10 * family] = w
        texts[10 * family + 1] = w + ["more"]
        texts[10 * family + 2] = w[:-1] + ["other"]
        texts[10 * family + 3] = w[: len(w) // 2] + ["mid"] + w[len(w) // 2 + 1 :]
    cut = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    want = {i: i for i in texts}
    for i in sorted(texts):
        for j in range(i - i % 10, i):
            if len(cut[i] & cut[j]) >= 0.8 * len(cut[i] | cut[j]):
                a, b = sorted((want[i], want[j]))
                want = {k: a if v == b else v for k, v in want.items()}
    assert 60 < len(set(want.values())) < len(want)
    docs = make_docs([(i, " ".join(w)) for i, w in texts.items()])
    for block in (1 << 13, 2):
        monkeypatch.setattr(resemblance, "SHARD", block)
        assert dict(by_id(resemblance.clustered(docs), "doc_id", "component_id")) == want


def test_long_texts_are_compared_exactly(make_docs):
    """Pairs below 0.8 stay apart and pairs from 0.8 on are found, however close to it."""
    docs, want = [], {}
    for family in range(60):
        w = [f"f{family}w{k}" for k in range(154)]  # 150 shingles
        share = (0.7, 0.75, 0.79, 0.8, 0.81, 0.85)[family % 6]
        fresh = int(150 * (1 - share) / (1 + share)) if share >= 0.8 else -int(-150 * (1 - share) // (1 + share))
        other = w[:-fresh] + [f"f{family}x{k}" for k in range(fresh)]
        sets = [{tuple(t[k : k + 5]) for k in range(150)} for t in (w, other)]
        near = len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        assert near == (share >= 0.8)
        docs += [(10 * family, " ".join(w)), (10 * family + 1, " ".join(other))]
        want |= {10 * family: 10 * family, 10 * family + 1: 10 * family + (not near)}
    got = dict(by_id(resemblance.clustered(make_docs(docs)), "doc_id", "component_id"))
    assert got == want


# 5 mixing


def targets_by_hand(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mix(make_docs, odd):
    r = random.Random(1)
    rows = [(i, prose(i, r.randrange(0, 40)), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(700)]
    rows += [(700, None, "e"), (701, "", "e")]
    docs = make_docs(rows)
    sized = mixing.sized(docs)
    goals = mixing.targets(sized)
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(words(t))
    want = targets_by_hand(sizes)
    assert {r.source: r.target for r in goals.collect()} == pytest.approx(want)
    taken, orders = Counter(), {}
    for r in mixing.mixed(sized, goals).collect():
        taken[r.source] += r.taken
        assert r["size"] == 0 or r.taken <= 2 * r["size"]
        orders.setdefault(r.source, []).append((r.key, r.before, r["size"]))
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    for order in orders.values():
        order.sort()
        assert [b for _, b, _ in order] == list(itertools.accumulate([0] + [n for *_, n in order[:-1]]))
    mix = mixing.mixed_documents(docs, mixing.places(docs), goals)
    assert mix.columns == docs.columns
    got = Counter()
    for r in mix.collect():
        got[r.source] += len(words(r.text))
    assert all(abs(got[s] - want[s]) <= 20 for s in want)
    assert mixing.mixed(mixing.sized(odd), mixing.targets(mixing.sized(odd))).count() == odd.count()
    places = mixing.places(odd)
    assert mixing.mixed_documents(odd, places, mixing.targets(places)).count() > 0
    places = mixing.places(odd.limit(0))
    assert mixing.mixed_documents(odd.limit(0), places, mixing.targets(places)).count() == 0
    none = mixing.sized(odd.limit(0))
    assert mixing.mixed(none, mixing.targets(none)).count() == 0


@pytest.mark.parametrize("same", ["nothing", "ids", "rows"])
def test_mix_of_rows_that_share_an_id_or_have_none(make_docs, same):
    """No source misses its target by more than one document, whatever rows have in common."""
    text = lambda i: "w " * 20 if same == "rows" else prose(i, 20)
    rows = [(None if same == "nothing" or i % 2 else 7, text(i), "a" if i % 3 else "b") for i in range(900)]
    rows += [(i, prose(i, 30), "c") for i in range(50)]
    docs = make_docs(rows)
    places = mixing.places(docs)
    goals = {r.source: r.target for r in mixing.targets(places).collect()}
    got = [Counter(), Counter()]
    for k in (0, 1):  # reruns agree
        mix = mixing.mixed_documents(docs, places, mixing.targets(places)).collect()
        for r in mix:
            got[k][r.source, r.text] += 1
    assert got[0] == got[1]
    for source, goal in goals.items():
        taken = sum(n * len(words(t)) for (s, t), n in got[0].items() if s == source)
        assert abs(taken - goal) <= 30, source
    given = Counter((r[2], r[1]) for r in rows)
    assert all(n <= 2 * given[k] for k, n in got[0].items())


# 6 and 10 classifiers


def test_features():
    texts = [b"a b, a b", b"", b"b,", b"c " * 5000]
    at, feature = features(texts, 18)
    assert np.bincount(at, minlength=4).tolist() == [6, 0, 3, 2]
    one = [features([t], 18)[1] for t in texts]
    assert np.concatenate(one).tolist() == feature.tolist()


def test_nonnegative_pu_and_ftrl_learn():
    r = np.random.default_rng(0)
    noise = lambda: r.integers(10, 400, 20)
    toxic = [np.unique(np.append(noise(), r.integers(0, 4, 2))) for _ in range(300)]
    clean = [np.unique(noise()) for _ in range(900)]
    positive = linear.Rows.of(toxic[:150])
    unlabelled = linear.Rows.of(toxic[150:] + clean[:700])
    model = toxicity.train(positive, unlabelled, 150 / 850, 0.02, 2.0)
    fresh = linear.Rows.of([np.unique(np.append(noise(), r.integers(0, 4, 2))) for _ in range(100)] + clean[700:])
    z = linear.sums(model.weights, fresh.owner(), fresh.index, len(fresh)) + model.bias
    truth = np.arange(len(fresh)) < 100
    assert ((z >= 0) == truth).mean() > 0.95
    w, b = linear.follow_the_leader(
        linear.Rows.of(toxic[:250] + clean[:250]), np.repeat([1.0, 0.0], 250), 512, alpha=2.0, l1=0.01, l2=0.0
    )
    z = linear.sums(w, fresh.owner(), fresh.index, len(fresh)) / np.sqrt(np.diff(fresh.start)) + b
    assert ((z >= 0) == truth).mean() > 0.95 and (w == 0).any()


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_documents(spark, odd, module, label):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    out = module.scored(docs, model, "score").join(labels, "doc_id")
    rows = [(r.score, r[label]) for r in out.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    ones, zeros = ([s for s, x in rows if x == k] for k in (1, 0))
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in zeros] for a in ones])
    assert auc > 0.75
    got = module.scored(odd, model, "n")
    assert got.columns == odd.columns and got.filter("n between 0 and 1").count() == odd.count()
    empty = module.fit(docs.limit(0), labels.limit(0))
    assert module.scored(odd, empty, "score").filter("score between 0 and 1").count() == odd.count()


def test_toxic_share_is_not_forced(spark, make_docs):
    """Labels with 40 % toxic texts, a corpus with hardly any, and empty texts."""
    r = random.Random(4)
    bad = lambda: f"{prose(r.random(), 20)} vile{r.randrange(3)} vile{r.randrange(3)}"
    rows = [(i, bad() if i < 80 else prose(i, 22)) for i in range(2000)]
    rows += [(i, "") for i in range(2000, 2100)]
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(200)], "doc_id long, toxic int")
    docs = make_docs(rows)
    out = dict(by_id(toxicity.scored(docs, toxicity.fit(docs, labels)), "doc_id", "toxicity"))
    assert sum(out[i] >= 0.5 for i in range(80)) >= 76
    assert sum(out[i] >= 0.5 for i in range(80, 2000)) <= 20
    assert all(out[i] < 0.5 for i in range(2000, 2100))
    toxic_only = toxicity.fit(docs, labels.filter("toxic = 1"), prior=0.04)  # nothing to calibrate on
    out = dict(by_id(toxicity.scored(docs, toxic_only), "doc_id", "toxicity"))
    assert sum(out[i] >= 0.5 for i in range(80)) >= 60 and all(out[i] < 0.5 for i in range(80, 2100))


# 7 lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def lines_by_hand(rows):
    placed = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if words(line):
                placed.append(((lines.NULL_ID if i is None else i, k), words(line)))
    placed.sort(key=lambda p: p[0])
    out, seen = {}, []
    for place, w in placed:
        why = None
        for before, v in seen:
            if before < place and v == w:
                why = "exact"
                break
            near = len(w) >= 8 and len(v) >= 8 and abs(len(v) - len(w)) < 2
            if before < place and near and distance(v, w) <= 1:
                why = "near"
        exact = any(before < place and v == w for before, v in seen)
        out[place] = "exact" if exact else why
        seen.append((place, w))
    return out


def test_lines(make_docs, odd):
    r = random.Random(2)
    base = [prose(i, r.choice([3, 7, 8, 9, 15, 30]), 50).split() for i in range(14)]

    def edited():
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            i, kind = r.randrange(len(w)), r.randrange(3)
            w[i : i + (kind > 0)] = [] if kind == 2 else [f"e{r.randrange(5)}"]
        return " ".join(w)

    rows = [(i, "\n".join(edited() for _ in range(r.randrange(0, 5)))) for i in range(60)]
    rows += [(None, edited()), (70, "\n\n  \n"), (71, None)]
    docs = make_docs(rows)
    found = lines.decided(docs).filter("line is not null")
    got = {(r.id, r.line_no): r.why for r in found.collect()}
    assert got == lines_by_hand(rows) and "near" in got.values()
    for i, t in by_id(lines.cleaned(docs), "doc_id", "text"):
        was = dict(rows)[i]
        place = lines.NULL_ID if i is None else i
        kept = [x for k, x in enumerate((was or "").split("\n")) if not got.get((place, k))]
        assert (t or "") == "\n".join(kept) and (t is None) == (was is None)
    assert lines.cleaned(odd).columns == odd.columns
    assert lines.per_document(lines.decided(odd.limit(0))).count() == 0
    assert lines.cleaned(odd.limit(0)).count() == 0
    rows = [(None, "A\nshared"), (None, "shared\nB"), (1, "x y\nz"), (1, "q\nx y\nx y"), (1, "q\nx y\nx y"), (2, None)]
    got = Counter((r.doc_id, r.text) for r in lines.cleaned(make_docs(rows)).collect())
    flat = [x for (_, t), n in got.items() for x in (t or "").split("\n") if x]
    assert sorted(flat) == sorted(["A", "shared", "B", "x y", "z", "q"]) and sum(got.values()) == len(rows)
    assert got[2, None] == 1 and max(got.values()) == 2  # equal rows stay equal
    assert by_id(lines.cleaned(odd).filter("doc_id = 5"), "text") == by_id(odd.filter("doc_id = 5"), "text")


# 8 URL lists


def test_url_lists(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    r = random.Random(4)
    patterns = ["a.com", "x.a.com", "b.org", "b.org/p", "com", "z.net"]
    events = [("l%d" % r.randrange(2), r.choice(patterns), day(r.randrange(30)), r.random() < 0.5) for _ in range(60)]
    events += [(None, "a.com", day(1), True), ("l0", None, day(1), True), ("l0", "b.org", None, True), ("l1", "com", day(3), None)]
    hosts = ["http://x.a.com/q?u=1", "https://A.com", "http://u@b.org:80/p/1#z", "http://b.org/other", "ftp://y.x.a.com/", "nothing", None, "http://notb.org/p"]
    captures = [(i, r.choice(hosts), day(r.randrange(32)), 1, 2) for i in range(120)] + [(500, hosts[0], None, 1, 2)]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_on date, pattern int, _span int")
    entries = spark.createDataFrame(events, "list string, pattern string, on date, added boolean")
    got = {r.page_id: {(m.list, m.pattern) for m in r.matches} for r in urls.judged(df, entries).collect()}
    for i, url, on, *_ in captures:
        site = re.match(r"[a-z]+://(?:[^/@]*@)?([^/:?#]+)(?::\d+)?(?:/([^/?#]*))?", url or "")
        want = set()
        if site and on:
            host, first = site[1].lower(), site[2] or ""
            for key in {(e[0], e[1]) for e in events if e[0] and e[1]}:
                hit = host == key[1] or host.endswith("." + key[1]) or f"{host}/{first}" == key[1]
                past = [(e[2], e[3] or False) for e in events if e[:2] == key and e[2] and e[2] <= on]
                if hit and past and max(past)[1]:
                    want.add(key)
        assert got[i] == want, (i, url, on)
    assert urls.judged(df.limit(0), entries).count() == 0
    assert urls.judged(df, entries.limit(0)).filter("size(matches) > 0").count() == 0


# 9 decontamination


def test_decontamination(spark, make_docs, odd, monkeypatch):
    r = random.Random(8)
    items = [(i, prose(100 + i, 30 + i, 9999)) for i in range(20)]
    items += [(50, "Short, Item: of seven words is here"), (51, "tiny one"), (52, None), (None, prose(900, 20, 9999))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for i in range(20):
        w = items[i][1].split()
        for k in range(6, len(w), 11):  # every 11th word replaced
            w[k] = "other"
        rows.append((i, f"{prose(i, 50, 9999)} {' '.join(w).upper()}. {prose(i + 50, 50, 9999)}"))
        want.add((i, i))
        rows.append((100 + i, f"{prose(i + 300, 80, 9999)} {' '.join(items[i][1].split()[:9])}"))
    rows += [(200, "so: short item of seven words, is here!"), (201, "tiny one")]
    docs = make_docs(rows)
    for tokens in (decontaminate.BLOCK_TOKENS, 100):  # the second needs several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", tokens)
        got = by_id(decontaminate.contaminated(docs, bench), "doc_id", "item_id")
        assert got == sorted(want | {(200, 50)}, key=repr)
    left = {r[0] for r in by_id(decontaminate.clean(docs, bench), "doc_id")}
    assert left == {i for i, _ in rows} - {i for i, _ in want} - {200}
    assert decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0


def accepted_items():
    """(length of the item, which of its tokens a copy has): all overlaps that count for items
    of 5 to 18 tokens, and for longer ones the first 13 matches of every segment that can."""
    rules = decontaminate.Rules()
    for n in range(5, 19):
        need = min(rules.least_matched, rules.short_share * n)
        for k in range(n + 1):
            for gone in itertools.combinations(range(n), k) if n - k >= need else ():
                same = np.ones(n, bool)
                same[list(gone)] = False
                a, b = decontaminate.best_segment(same)
                if same[a:b].sum() >= need:
                    yield n, "".join("01"[x] for x in same.tolist())
    todo = [("", 0)]
    while todo:
        seen, score = todo.pop()
        if seen.count("1") == rules.least_matched:
            yield 99, seen
            continue
        todo.append((seen + "1", score + 1))
        if score >= 2:
            todo.append((seen + "0", score - 2))


def test_seeds_hit_whatever_counts():
    seeds = {}
    for n, same in accepted_items():
        seeds.setdefault(n, set()).add(same)
    assert len(seeds) == 15 and len(seeds[99]) == 3876 and len(seeds[5]) == 3
    for n, all_same in seeds.items():
        masks = [m.replace("0", ".") for m in decontaminate.MASKS[min(n, decontaminate.LONGEST)]]
        found = re.compile("|".join(masks))
        assert [same for same in all_same if not found.search(same)] == []


def test_replaced_tokens_of_short_items(spark, make_docs):
    items = [(n, prose(700 + n, n, 9999)) for n in range(5, 25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for n, text in items:
        for trial in range(40):
            r, w = random.Random(100 * n + trial), text.split()
            for k in r.sample(range(n), 1 + trial % max(1, n // 5)):
                w[k] = "other"
            same = np.array([x != "other" for x in w])
            a, b = decontaminate.best_segment(same)
            rows.append((100 * n + trial, f"{prose(n, 9, 99)} {' '.join(w)} {prose(n + 50, 9, 99)}"))
            if same[a:b].sum() >= min(13, 0.8 * n):
                want.add((100 * n + trial, n))
    assert {n for _, n in want} == set(range(5, 25))
    got = by_id(decontaminate.contaminated(make_docs(rows), bench), "doc_id", "item_id")
    assert got == sorted(want, key=repr)

"""The training-data operators against brute force on small tables with the awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from medloom.llm import bpe, catalog, clustering, exact_dedup, graph, language_id, line_dedup, mixing, ppm, quality_rules, sentencepiece_bpe, sharding, simhash, url_filter
from medloom.llm.common import Scratch, ranked, spread_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, _key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    vocab = ["the", "of", "and", "house", "tree", "água", "Été", "x#", "naïve", "river", "stone", "cloud", "42", "glass"]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 14)))
    common = line()
    out = []
    for k in range(160):
        lines = [line() for _ in range(rng.randint(1, 6))]
        if k % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), common.upper() if k % 2 else f"  {common}\t")
        out.append("\n".join(lines))
    out += [out[3], out[3] + " ", out[3].replace(" ", "  "), out[5], out[5]] + ["a b c d e f g"] * 12
    return [*out, None, "", " \n\t", "one", "one two", "word " * 3000, "x" * 40000, "\n\n", "same line\nsame line\nsame line", "éè\x85\xa0ü"]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, ["en", "fr", None][k % 3], None if k % 17 == 0 else f"s{k % 4}", 0, "clash", "clash", "clash") for k, t in enumerate(texts())]
    return [*out, (None, "no id here", None, None, None, None, None, None), out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("v"))
    got = ranked(Scratch(spark, "t"), df, F.col("v"), within="g").collect()
    want = {g: {v: i for i, v in enumerate(sorted(-k for k in range(1000) if k % 3 == g))} for g in range(3)}
    assert all(r["rank"] == want[r.g][r.v] for r in got) and len(got) == 1000


def test_exact_groups(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    for blocks in ((32, 8), (2, 2)):
        got = exact_dedup.exact_groups(docs, first_block=blocks[0], widening=blocks[1]).collect()
        text_of = {r[0]: r[1] for r in rows}
        assert len(got) == len(rows)
        for r in got:
            key = norm(text_of[r.doc_id])
            best = min(groups[key])
            assert r.keep_id == (None if best[1] else best[2]) and r.group_size == len(groups[key])
            assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()
        assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.exact_dedup(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert {norm(r.text) for r in left.collect()} == set(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def brute_print(text, n=3):
    words = WORDS.findall(ascii_lower(text))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """{print: smallest print reachable}"""
    todo, out = sorted(set(prints)), {}
    for p in todo:
        if p in out:
            continue
        stack, seen = [p], {p}
        while stack:
            x = stack.pop()
            for y in todo:
                if y not in seen and (x ^ y).bit_count() <= radius:
                    seen.add(y)
                    stack.append(y)
        out |= dict.fromkeys(seen, p)
    return out


def test_covering_masks():
    rng = random.Random(1)
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(diff & m == 0 for m in masks)
    finer = simhash._finer(masks[0], 3)
    for _ in range(500):
        hidden = [i for i in range(64) if not masks[0] >> i & 1]
        diff = sum(1 << b for b in rng.sample(hidden, 3))
        assert any(diff & m == 0 for m in finer)


def test_simhash(docs, rows, empty):
    got = simhash.simhash_components(docs).collect()
    text_of = {r[0]: r[1] for r in rows}
    roots = brute_components([brute_print(r[1]) for r in rows])
    first = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            first[roots[brute_print(r[1])]].append(r[0])
    assert len(got) == len(rows)
    for r in got:
        p = brute_print(text_of[r.doc_id])
        assert r.fp & (1 << 64) - 1 == p
        assert r.component_id == min(first.get(roots[p], []), default=None)
    assert simhash.fingerprint("a b c d e " * 9000) == brute_print("a b c d e " * 9000)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("shingle,radius", [(3, 3), (5, 6)])
def test_near_dedup(docs, rows, empty, shingle, radius):
    """One row of each component, also of rows that repeat an id or have none."""
    near = rows + [(900 + k, " ".join(f"w{i}" if i != k * 20 else "other" for i in range(300)), None, None, None, "x", "y", "z") for k in range(4)]
    prints = [brute_print(r[1], shingle) for r in near]
    roots, best = brute_components(prints, radius), {}
    for r, p in zip(near, prints):
        key = (r[0] is None, r[0] or 0)
        best[roots[p]] = min(best.get(roots[p], (True, 1 << 60)), key)
    left = simhash.near_dedup(docs.sparkSession.createDataFrame(near, SCHEMA).repartition(3), radius=radius, shingle=shingle)
    assert left.columns == docs.columns
    got = left.collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(best.values())
    assert len(got) < len(near) and simhash.near_dedup(empty).count() == 0


def test_heavy_buckets_lose_no_link(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
    prints |= {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    scratch = Scratch(spark, "t")
    for most in (4096, 8):
        edges = simhash.near_links(scratch, df, 3, most)
        roots = {r.node: r.root for r in graph.components(scratch, edges).collect()}
        want = brute_components(prints)
        mine = defaultdict(set)
        for p in prints:
            mine[roots.get(simhash._signed(p), simhash._signed(p))].add(p)
        theirs = defaultdict(set)
        for p, root in want.items():
            theirs[root].add(p)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_path(spark):
    edges = spark.range(400).select((F.col("id") * 7 % 401).alias("a"), ((F.col("id") + 1) * 7 % 401).alias("b"))
    assert {r.root for r in graph.components(Scratch(spark, "t"), edges).collect()} == {0}


def test_quality_rules(docs, rows, empty):
    per = defaultdict(set)
    for n, r in enumerate(dict.fromkeys(rows)):
        for x in (r[1] or "").split("\n"):
            if norm(x):
                per[r[3], ascii_lower(x.strip(" \t\n\x0b\x0c\r"))].add(n)
    got = quality_rules.quality_rules(docs, max_line_docs=6).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert len(got) == len(rows)
    for r in rows:
        text = r[1] or ""
        words = WORDS.findall(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in text.split("\n") if norm(x)]
        gone = sum(len(WORDS.findall(x)) for x in lines if len(per[r[3], ascii_lower(x.strip(" \t\n\x0b\x0c\r"))]) > 6)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        left = len(words) - gone
        kept = not failed and not (gone and (left < 10 or left < 0.2 * len(words)))
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, left, kept)
        g = by_id[r[0]][0]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.n_left_words, g.kept) == want, r[0]
    assert any(not r.kept and not r.base_failed for r in got) and quality_rules.quality_rules(empty).count() == 0
    kept = Counter((r.doc_id, r.n_left_words) for r in got if r.kept)
    out = quality_rules.cleaned_documents(docs, max_line_docs=6)
    assert out.columns == docs.columns and quality_rules.cleaned_documents(empty).count() == 0
    texts_of, cleaned = {r[0]: r for r in rows}, out.collect()
    assert Counter((r.doc_id, len(WORDS.findall(r.text))) for r in cleaned) == kept
    for r in cleaned:
        _, text, _, host, *rest = texts_of[r.doc_id]
        stay = [x for x in text.split("\n") if len(per[host, ascii_lower(x.strip(" \t\n\x0b\x0c\r"))]) <= 6]
        assert r.text == "\n".join(stay) and (r.source, r.row) == (host, "clash")


def test_null_and_empty_hosts_are_two(spark):
    rows = [(k, f"shared line of many words\n{' '.join(f'w{k}x{i}' for i in range(20))}", None if k % 2 else "") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = lambda n: {r.n_left_words for r in quality_rules.quality_rules(df, max_line_docs=n).collect()}
    assert left(5) == left(4) == {25} and left(3) == {20}


def test_line_dedup(spark, docs, rows, empty):
    counts = Counter()
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    for r in rows:
        counts.update({key(x) for x in (r[1] or "").split("\n")} - {""})
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < 10]
        want[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    for batches in (None, [docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 = 1 OR doc_id IS NULL"), docs.where("doc_id % 5 = 2"), docs.where("doc_id % 5 > 2")]):
        out = line_dedup.dedup_lines(docs, batches=batches)
        assert set(docs.columns) < set(out.columns)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()) == want
    assert any(k[2] for k in want) and line_dedup.dedup_lines(empty).count() == 0


def test_line_runs_of_the_query(spark, monkeypatch):
    """The registered query on a table of one file: twelve batches, two levels of merges, merge joins with the runs, no table left."""
    made, plans = [], []

    class Watched(line_dedup.LineRuns):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

        def unknown(self, batch):
            out = super().unknown(batch)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out

    monkeypatch.setattr(line_dedup, "LineRuns", Watched)
    assert catalog.QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.001").count() > 0
    assert made[0].added == line_dedup.BATCHES == 12 and made[0].merges == [1, 1, 1, 2, 1]
    joined = [p.count("SortMergeJoin") for p in plans]
    assert joined == [0, 1, 2, 1, 2, 3, 2, 3, 4, 1, 2, 3] and not any("BroadcastHashJoin" in p for p in plans)
    # The runs lie in their buckets: only the batch itself is dealt out.
    assert all(p.count("Exchange hashpartitioning") == 1 for p in plans)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_sharding(docs, rows, empty, spark):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
        where[r.text or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0
    # A third of the rows in one group: it is cut, all others stay together.
    rng = random.Random(2)
    many = [(k, 7 if k % 3 == 0 else rng.randrange(-(2**62), 2**62), rng.randint(1, 50)) for k in range(3000)]
    out = sharding.shard(spark.createDataFrame(many, "doc_id long, group long, size long"), 8).collect()
    sizes, groups = Counter(), defaultdict(set)
    for r in out:
        sizes[r.shard] += r.size
        groups[r.group].add(r.shard)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(s - mean) for s in sizes.values()) <= 0.01 * mean + 50
    assert all(len(s) == 1 for g, s in groups.items() if g != 7) and len(groups[7]) > 1


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    open_ = set(order)
    while open_:
        left = total - sum(target.values())
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= cap * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        target |= {s: cap * sizes[s] for s in full}
        open_ -= full
    return target


def test_mixing(docs, rows, empty):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    want = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) for r in got)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.05 * t + 40, (s, taken[s], t)
    again = mixing.mix(docs.repartition(5)).collect()
    plain = lambda out: sorted(str((r.doc_id, r.source, r.size, r.copies, r.taken)) for r in out)
    assert plain(again) == plain(got)
    # The rates meet the targets exactly: that is the entropy-balancing solution.
    for s in want:
        assert abs(sum(r.rate * r.size for r in got if r.source == s) - want[s]) < 1e-6 * max(1, want[s])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0


def test_mixing_of_repeated_rows(spark):
    """Rows that repeat each other are taken one by one: targets are met within a document."""
    rows = [(1, "w " * 10, "a")] * 30 + [(k, "w " * 10, "b") for k in range(40)] + [(k, "w " * 7, None) for k in (5, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(3)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 10 for s in target), (taken, target)
    assert len({r.copies for r in got if r.source == "a"}) > 1
    thin = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    scratch = Scratch(spark, "t")
    nth = defaultdict(list)
    for r in mixing.numbered(scratch, scratch.keep(thin)).collect():
        nth[r.doc_id, r.source, r["size"]].append(r.nth)
    assert all(sorted(x) == list(range(len(x))) for x in nth.values()) and len(nth[1, "a", 10]) == 30


def test_a_search_without_end_is_an_error(docs, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    monkeypatch.setattr(mixing, "MAX_NEWTON", 1)
    with pytest.raises(RuntimeError, match="miss their targets"):
        mixing.mix(docs).count()


def test_targets_that_are_capped(spark):
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate([("a", 1)] * 3 + [("b", 100)] * 5 + [("c", 2)] * 3 + [("d", 90)] * 4)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = brute_targets({"a": 3, "b": 500, "c": 6, "d": 360})
    assert want["a"] == 9 and want["c"] == 18
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert taken["a"] == 9 and taken["c"] == 18


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_transducer(ranks):
    import tiktoken

    table = bpe.read_ranks(ranks[0])
    theirs = tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})
    rng = random.Random(4)
    alphabet = list("abcdefghij  tingousxyz\n\t12.,éß中ñÁ🤦‍♂️'") + ["the", "ing", "tion", "<|endoftext|>"]
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    samples += ["a" * 3000, "ab" * 700, " " * 300, "\n" * 90, "th" * 2000, "", "x" * 65 + "tion" * 30, "".join(rng.choice("etaoinshr") for _ in range(5000))]
    for pairs in (200_000, 50):
        mine, back = bpe.Encoder(table, ranks[1], max_pairs=pairs, max_pieces=40), bpe.Decoder(table)
        for s in samples + samples[:500]:
            ids = list(mine.encode(s))
            assert ids == theirs.encode_ordinary(s)
            assert "".join(back.decode(ids)) == s
        assert mine.transducer.n_pairs <= pairs and len(mine.transducer.states) <= 1 + len(mine.transducer.prefixes)


def test_transducer_emits_before_the_end(ranks):
    """In a long piece, what all live starts share is settled and leaves the window."""
    machine = bpe.Transducer(bpe.read_ranks(ranks[0]))
    rng, places = random.Random(7), []
    settled = machine._settled
    machine._settled = lambda last, live: places.append((len(last), settled(last, live))) or places[-1][1]
    machine.encode("".join(rng.choice("etaoinshr") for _ in range(20_000)).encode())
    assert len(places) >= 19 and all(n <= bpe.WINDOW + 64 and p > n - 64 for n, p in places)


def test_utf8_machine():
    rng = random.Random(6)
    pool = [0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xC3, 0xA9, 65, 0xED, 0xA0, 0xF4, 0x90, 0xC0]
    for _ in range(5000):
        raw = bytes(rng.choice([rng.randrange(256), *pool]) for _ in range(rng.randrange(12)))
        machine = bpe.Utf8Machine()
        assert "".join(machine.feed(raw[i : i + 2]) for i in range(0, len(raw), 2)) + machine.end() == raw.decode("utf-8", "replace")


def test_encode_and_decode(docs, rows, empty, ranks):
    import tiktoken

    theirs = tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=bpe.read_ranks(ranks[0]), special_tokens={})
    encoded = bpe.encode(docs, *ranks, out_col="row")
    assert set(encoded.columns) == set(docs.columns)
    text_of = {r[0]: r[1] or "" for r in rows}
    got = bpe.decode(encoded.select("doc_id", "row"), ranks[0], ids_col="row").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.row == theirs.encode_ordinary(text_of[r.doc_id]) and r.text == text_of[r.doc_id]
    both = bpe.round_trip(docs.select("doc_id", "text"), *ranks).collect()
    assert all(r.ids == theirs.encode_ordinary(text_of[r.doc_id]) and r.decoded == text_of[r.doc_id] for r in both)
    assert bpe.encode(empty, *ranks).count() == 0


def test_ppm_contract(docs, rows, empty):
    got = ppm.score_documents(docs).collect()
    tokens = {k: [w.encode() for w in WORDS.findall(ascii_lower(r[1]))] + [ppm.END] for k, r in enumerate(rows)}
    ids = {k: b"" if r[0] is None else str(r[0]).encode() for k, r in enumerate(rows)}
    counts = Counter(w for k, ws in tokens.items() if crc32(ids[k]) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for k, ws in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        want[rows[k][0], crc32(ids[k]) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert ppm.score_documents(empty).count() == 0


class PlainPpm:
    """The contexts of a few texts in plain dictionaries, byte by byte."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for text in texts:
            self.count(self.coded(text), 1)
        self.escape = np.full(ppm.CLASSES, 0.5)

    @staticmethod
    def coded(words):
        return ppm.END * ppm.ORDER + b"".join(w + b" " for w in words) + ppm.END

    def count(self, data, n, places=None):
        for i in places or range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                self.seen[data[i - k : i]][data[i]] += n

    def levels(self, data, i):
        """(order, class of the escape, what is not excluded, whether the byte is in it), longest first, until it is."""
        excluded = set()
        for k in range(ppm.ORDER, -1, -1):
            context = data[i - k : i]
            left = {s: c for s, c in self.seen.get(context, {}).items() if c and s not in excluded}
            if left:
                n, d = sum(left.values()), len(left)
                within = len(context) - 1 - max(context.rfind(b" "), context.rfind(ppm.END))
                at = ppm._class(np.array([n]), np.array([d]), 0)[0] + within + {5: 0, 4: 6, 3: 11}.get(k, 0)
                yield k, at, left, data[i] in left
                if data[i] in left:
                    return
                excluded |= set(left)

    def log_p(self, data, i):
        p = 1.0
        for k, at, left, hit in self.levels(data, i):
            n, d = sum(left.values()), len(left)
            e = self.escape[at] if k > 2 else 0.5 * d / n
            p *= ((1 - e) * left[data[i]] if k > 2 else left[data[i]] - 0.5) / n if hit else e
            if hit:
                return math.log10(p)
        return math.log10(p / (256 - sum(1 for c in self.seen[b""].values() if c)))

    def estimate(self, texts):
        """Escapes of each class, each byte of the texts taken out, coded and put back."""
        tries, escapes = np.zeros(ppm.CLASSES), np.zeros(ppm.CLASSES)
        for data in map(self.coded, texts):
            for i in range(ppm.ORDER, len(data)):
                self.count(data, -1, [i])
                for k, at, _, hit in self.levels(data, i):
                    if k > 2:
                        tries[at] += 1
                        escapes[at] += not hit
                self.count(data, 1, [i])
        self.escape = np.clip((0.5 + escapes) / (1.0 + tries), 1e-9, 0.999)
        return tries, escapes


def test_ppm_contexts_are_exact_across_parts():
    """Contexts run over token borders, and scores and escapes from parts equal those of a plain model of the whole."""
    rng = random.Random(6)
    vocab = [b"ab", b"abcab", b"c", b"bca", "é".encode(), b"abcabcabcabc"]
    texts = [[rng.choice(vocab) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    new = [[rng.choice([*vocab, b"zz", b"cab"]) for _ in range(6)] for _ in range(10)]
    each = [ppm._document_keys([*t, ppm.END]) for t in texts]
    keys = np.unique(np.concatenate([*each, *(ppm._document_keys([*t, ppm.END]) for t in new)]))
    assert np.array_equal(ppm._unpacked(ppm._packed(keys)), keys) and len(ppm._unpacked(ppm._packed(keys[:0]))) == 0
    counts = (np.concatenate(each)[:, None] == keys).sum(axis=0)
    plain = PlainPpm(texts)
    want = plain.estimate(texts)
    borders = np.unique(keys >> 24)
    for splitters in ([], borders[[1, 5, 6, 20]]):
        cuts = [0, *np.searchsorted(keys, np.array(splitters, np.int64) << 24), len(keys)]
        parts = [ppm.Contexts(keys[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:])]
        two = Counter()
        for p in parts:
            for q, n in zip(*p.pair_counts()):
                two[int(q)] += n
        one = np.zeros((256, 256))
        for q, n in two.items():
            one[q >> 8 & 255, q & 255] += n
        estimated = np.sum([p.escapes() for p in parts], axis=0)
        assert np.array_equal(estimated, want) and estimated[1].sum() > 0
        lp = []
        for p in parts:
            mine = {q: n for q, n in two.items() if n and q >> 8 in set(p.q.tolist())}
            lower = ppm.Lower(np.array([*mine], np.int64), np.array([*mine.values()]), one)
            lp.append(p.log_p(lower, ppm.escape_estimates(*estimated)) / np.log(10))
        for text in texts + new:
            coded = [*text, ppm.END]
            numbers = {w: k for k, w in enumerate(dict.fromkeys(coded))}
            twice = ppm._document_scores([np.array([numbers[w] for w in coded])] * 2, [*numbers], keys, np.concatenate(lp))
            data = plain.coded(text)
            assert np.allclose([*twice], sum(plain.log_p(data, i) for i in range(ppm.ORDER, len(data))))


def test_ppm_scores_equal_a_plain_model(spark, monkeypatch):
    """Whole documents through all jobs, with many chunks and parts; held-out texts change nothing."""
    rng = random.Random(12)
    vocab = ["stone", "River", "cloud", "été", "house", "a", "an", "and", "日本"]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25)))) for k in range(70)] + [(None, None), (70, " \n\t"), (3, "stone stone")]
    tokens = [[w.encode() for w in WORDS.findall(ascii_lower(t))] for _, t in rows]
    learnt = [t for (k, _), t in zip(rows, tokens) if not ppm.held_out(k)]
    plain = PlainPpm(learnt)
    plain.estimate(learnt)
    want = Counter()
    for (k, _), t in zip(rows, tokens):
        data = plain.coded(t)
        want[k, round(sum(plain.log_p(data, i) for i in range(ppm.ORDER, len(data))), 3)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, round(r.score, 3)) for r in ppm.score_documents(df).collect()) == want
    monkeypatch.setattr(ppm, "PART_BYTES", 600)
    for size in (300, 1 << 23):
        monkeypatch.setattr(ppm, "CHUNK_BYTES", size)
        got = ppm.score_documents(df.repartition(3)).collect()
        assert Counter((r.doc_id, round(r.score, 3)) for r in got) == want
    other = [(k, f"{t} never seen zzz" if ppm.held_out(k) else t) for k, t in rows]
    again = ppm.score_documents(spark.createDataFrame(other, "doc_id long, text string")).collect()
    learnt_only = lambda out: Counter((r.doc_id, round(r.score, 3), r.train_tokens) for r in out if not r.held_out)
    assert learnt_only(again) == learnt_only(got) and any(r.held_out for r in got)


def test_ppm_scores_word_order(spark):
    """Words in an order that the training texts have score above the same words shuffled."""
    rng = random.Random(4)
    vocab = ["stone", "river", "cloud", "glass", "house", "tree", "field", "light"]
    lines = [" ".join(vocab[(k + i) % 8] for i in range(40)) for k in range(8)]
    ids = iter(range(10**6))
    held = [i for i in range(2000) if ppm.held_out(i)]
    rows = [(i, lines[i % 8]) for i in (next(ids) for _ in range(400)) if not ppm.held_out(i)]
    pairs = []
    for a, b in zip(held[0:40:2], held[1:41:2]):
        words = rng.choice(lines).split()
        mixed = rng.sample(words, len(words))
        rows += [(a, " ".join(words)), (b, " ".join(mixed))]
        pairs.append((a, b))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score_documents(df).collect()}
    for a, b in pairs:
        assert math.isclose(got[a].base_score, got[b].base_score) and got[a].score > got[b].score + 5


LABELLED = [("en", "the house and the tree of the river"), ("fr", "le chat et la maison de la rivière"), ("de", "der hund und das haus mit dem fluss")]


def test_language_id(spark, docs, empty):
    rng = random.Random(9)
    rows = []
    for k in range(300):
        lang, base = LABELLED[k % 3]
        ws = base.split()
        rows.append((k, " ".join(rng.choice(ws) for _ in range(12)), lang if k % 10 else LABELLED[(k + 1) % 3][0], f"h{k % 3}.example.{['com', 'fr', 'de'][k % 3]}"))
    rows += [(900, None, None, None), (901, "", "en", "h0.example.com"), (902, "12345 999", None, "h0.example.com"), (903, "qqq zzz", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("suffix", F.substring_index("source", ".", -1))
    got = {r.doc_id: r for r in language_id.identify(df, suffix_col="suffix").collect()}
    right = sum(got[k].language == LABELLED[k % 3][0] for k in range(300))
    assert right >= 295 and all(got[k].accepted for k in range(300))
    assert not any(got[k].accepted for k in (900, 901, 902, 903)) and len(got) == 304
    kept = language_id.keep_known_languages(docs)
    assert kept.columns == docs.columns
    assert language_id.identify(empty).count() == 0 and language_id.keep_known_languages(empty).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify(unlabelled).where("accepted").count() == 0
    page = '<!DOCTYPE html><html lang="fr"><head><script>var the = "of";</script></head><body><p>le chat</p></body></html>'
    pages = spark.createDataFrame([(1, "http://A.example.FR/x?y", page), (2, None, None)], "page_id long, url string, html string")
    e = language_id.page_evidence(pages).orderBy("page_id").collect()
    assert (e[0].declared, e[0].host, e[0].suffix, e[0].text.split()) == ("fr", "a.example.fr", "fr", ["le", "chat"]) and e[1].host is None


def test_language_id_of_small_languages_and_scripts_without_spaces(spark):
    """A small language and one without spaces beside a large one, and texts without any known feature."""
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    signs, small = [chr(0x4E00 + i) for i in range(60)], ["ze", "vrouw", "kwam", "thuis", "zou", "worden"]
    chinese = lambda: "".join(rng.choice(signs) for _ in range(60))
    rows = [(k, " ".join(rng.sample(vocab, 40)), "en", "a.example") for k in range(600)]
    rows += [(1000 + k, chinese(), "zh" if k < 20 else None, None) for k in range(30)]
    rows += [(2000 + k, " ".join(rng.choice(small) for _ in range(12)), "nl" if k < 8 else None, None) for k in range(12)]
    rows += [(3000, "ωωω ψψψ", "en", None), (3001, "λλλ ξξξ", None, "a.example"), (3002, "σσσ δδδ", None, None), (3003, "", "en", "a.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model, one_in = language_id.fit(df, "text", "lang", 90, 2)
    assert model.languages == ["en", "nl", "zh"] and set(small) <= set(model.at) and one_in == {"en": 21, "nl": 1, "zh": 1}
    got = {r.doc_id: r for r in language_id.identify(df, sample_rows=90).collect()}
    assert all(got[k].accepted and got[k].language == "zh" for k in range(1000, 1030))
    assert all(got[k].accepted and got[k].language == "nl" for k in range(2000, 2012))
    assert sum(got[k].accepted and got[k].language == "en" for k in range(600)) == 600
    assert got[3001].known_features == got[3002].known_features == 0
    assert [got[k].accepted for k in range(3000, 3004)] == [True, True, False, False] and got[3000].language == got[3001].language == "en"


def plain_language_id(rows, min_count=3):
    """{doc_id: (language, confidence)} of few rows, all learnt from, and the trust that no row outside the fit has changed."""
    said = {r[0]: (r[2] or "").lower() for r in rows}
    langs = sorted({x for x in said.values() if x})
    per = {x: Counter() for x in langs}
    for lang, text in {(said[r[0]], r[1]) for r in rows if said[r[0]]}:
        per[lang].update(language_id.features(text))
    known = {f for c in per.values() for f, n in c.items() if n >= min_count}
    sums = {x: sum(per[x][f] for f in known) for x in langs}
    add = {x: 0.5 * max(sums[x], 1) / max(1, max(sums.values())) for x in langs}
    log = {x: {f: math.log((per[x][f] + add[x]) / (sums[x] + add[x] * len(known))) for f in known} for x in langs}
    trust = language_id.TRUST_RIGHT / language_id.TRUST_ROWS
    two, vote = {}, {}
    for k, text, _, _ in rows:
        found = {f: n for f, n in language_id.features(text).items() if f in known}
        n = sum(found.values())
        two[k] = {x: sum(log[x][f] * m for f, m in found.items()) * min(1.0, 60 / n) if n else 0.0 for x in langs}
        for x in langs:
            two[k][x] += 0 if said[k] not in langs else math.log(trust if x == said[k] else (1 - trust) / (len(langs) - 1))
        vote[k] = min(langs, key=lambda x: (-round(two[k][x], 9), x)) if n or said[k] in langs else None
    at = {k: (host or None, (host or "").rpartition(".")[2] if "." in (host or "") else None) for k, _, _, host in rows}
    corpus = {x: (sum(v == x for v in vote.values()) + 1) / (sum(v is not None for v in vote.values()) + len(langs)) for x in langs}
    out = {}
    for k, *_ in rows:
        prior = corpus
        for level in (1, 0):
            mates = [j for j in at if at[k][level] is not None and (at[j] if level == 0 else at[j][1]) == (at[k] if level == 0 else at[k][1]) and vote[j]]
            if mates:
                n = len(mates) - (vote[k] is not None)
                prior = {x: (sum(vote[j] == x for j in mates) - (vote[k] == x) + 20 * prior[x]) / (n + 20) for x in langs}
        post = {x: two[k][x] + math.log(prior[x]) for x in langs}
        best = min(langs, key=lambda x: (-round(post[x], 9), x))
        out[k] = best, 1 / sum(math.exp(p - post[best]) for p in post.values())
    return out


def test_language_id_equals_a_plain_version(spark):
    """Likelihood, declared language, host, suffix and corpus, and a row's own vote left out."""
    rng = random.Random(15)
    vocab = {"en": "the of and house river stone", "fr": "le la et maison stone rue", "de": "der die und haus fluss stone"}
    hosts = ["a.example.com", "b.example.fr", "c.example.fr", "plain", None, ""]
    rows = []
    for k in range(150):
        lang = ["en", "fr", "de"][k % 3]
        words = vocab[lang].split() + ["stone", "qqq"]
        said = [lang, None, "", rng.choice(["en", "fr", "de"]), lang.upper()][k % 5]
        rows.append((k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 9, 90]))), said, rng.choice(hosts)))
    want = plain_language_id(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language_id.identify(df.repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.language == want[r.doc_id][0] and math.isclose(r.confidence, want[r.doc_id][1], rel_tol=1e-6), r
    assert len({round(r.confidence, 3) for r in got}) > 20


def test_trust_is_measured_outside_the_fit(spark):
    """Declared languages that are wrong in half of the rows are trusted less where there are more rows than the sample takes."""
    rows = [(k, LABELLED[k % 2][1] + f" w{k}", LABELLED[(k + k // 2) % 2][0], None) for k in range(400)] + [(1000, "ωωω", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sure = {n: language_id.identify(df.where("doc_id = 1000 OR doc_id < 400"), sample_rows=n).where("doc_id = 1000").first().confidence for n in (60, 4000)}
    assert sure[60] < 0.65 and sure[4000] > 0.8


def test_rows_without_a_key_find_nothing(spark):
    """Rows without a key are dealt out by numbers, which can be names of keys."""
    scratch = Scratch(spark, "t")
    for n in (1, 20_000):
        # One key is hot, or none is.
        table = scratch.keep(spark.range(n).select(F.col("id").cast("string").alias("host"), F.lit(1).alias("n"), F.lit("x").alias("v")))
        rows = spark.createDataFrame([(k, None if k % 2 else "0") for k in range(40)], "id long, host string")
        got = spread_join(rows, table, ["host"], "n", F.lit(0)).collect()
        assert len(got) == 40 and all((r.found is None) == (r.host is None) for r in got)


def test_a_thousand_languages(spark):
    """Every declared name is learnt, however many there are, and a text finds its own among all."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    rows = []
    for lang in range(1000):
        vocab = [word() for _ in range(6)]
        for k in range(6):
            said = [f"l{lang:04d}", None][k == 5]
            rows.append((lang * 10 + k, " ".join(rng.choices(vocab, k=12)), said, [f"h{lang % 7}.example.org", None][lang % 3 == 0]))
    rows += [(10**6, "ωωω ψψψ", "l0007", None), (10**6 + 1, "ωωω ψψψ", None, None), (10**6 + 2, "ωωω ψψψ", "x" * 101, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    model, one_in = language_id.fit(df, "text", "lang")
    assert len(model.languages) == 1000 and set(one_in.values()) == {1}
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == len(rows)
    right = sum(got[r[0]].language == f"l{r[0] // 10:04d}" and got[r[0]].accepted for r in rows[:-3])
    assert right >= 0.99 * 6000 and got[10**6].language == "l0007"
    assert not got[10**6 + 1].accepted and not got[10**6 + 2].accepted


def test_language_id_of_declared_names_in_capitals(spark):
    rows = [(k, LABELLED[k % 2][1], ["EN", "pt-BR", "en", "pt-br"][k % 4]) for k in range(40)] + [(40, "ωωω ψψψ", "pt-BR")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string"))
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(got[k].accepted and got[k].language == ["en", "pt-br"][k % 2] for k in range(40))
    assert got[40].accepted and got[40].language == "pt-br"


def test_url_rules(spark):
    rows = [
        (1, "http://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (2, "https://a.example.com/en/2#t", "a.example.com", "/en/2", "example.com/en/", "block"),
        (3, "https://a.example.com/fr/2", "a.example.com", "/fr/2", "com/", "allow"),
        (4, "https://a.example.net/fr/2", "a.example.net", "/fr/2", "net/fr/", "block"),
        (5, "https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (6, "https://com", "com", "", None, "allow"),
        (7, "no scheme", "", "", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "x://h?q://z/", "h", "", None, "allow"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    for k, _, host, path, rule, verdict in rows:
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        if rule:
            assert got[k].verdict == verdict
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    only = url_filter.filter_urls(pages, rules=[("allow", "com/")])
    assert only.where("verdict = 'block'").count() == 0


def test_url_model_learns(spark):
    rng = random.Random(11)
    good, bad = ["garden", "library", "science"], ["casino", "pills", "betting"]
    rows = []
    for k in range(900):
        kind = k % 2
        rows.append((k, f"http://{rng.choice(bad if kind else good)}{rng.randrange(50)}.{['com', 'net', 'org'][k % 3]}/{rng.randrange(999)}"))
    rules = [("allow", f"{g}{n}.{t}/") for g in good for n in range(50) for t in ("com",)] + [("block", f"{b}{n}.{t}/") for b in bad for n in range(50) for t in ("com",)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).where("rule IS NULL").collect()
    right = sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in got)
    assert right / len(got) > 0.95


def plain_grams(urls):
    counts = Counter()
    for url in urls:
        data = url_filter._symbols(*url)
        for end in range(2, len(data) + 1):
            for start in range(max(0, end - 1 - url_filter.ORDER), end):
                counts[data[start:end]] += 1
    return counts


def plain_markov(urls):
    """Log probability of a byte after its context, from plain dictionaries."""
    grams, total, kinds = plain_grams(urls), Counter(), Counter()
    for gram, n in grams.items():
        total[gram[:-1]] += n
        kinds[gram[:-1]] += 1

    def log_p(context, byte):
        p = 1 / 256
        for n in range(len(context) + 1):
            c = context[len(context) - n :]
            if not total[c]:
                break
            p = (grams[c + byte] + kinds[c] * p) / (total[c] + kinds[c])
        return math.log(p)

    return log_p


def test_url_model_is_a_distribution():
    counts = plain_grams([("abc", "/"), ("abd", "/é")])
    keys = np.array([int.from_bytes(bytes([len(g)]) + g, "big") for g in counts])
    model = url_filter.MarkovModel(keys, np.array([*counts.values()]))
    data = np.array([x for b in range(256) for x in (1, 97, 98, b)])
    p = model.p(data, np.tile(np.arange(4), 256))[3::4]
    plain = plain_markov([("abc", "/"), ("abd", "/é")])
    assert abs(p.sum() - 1) < 1e-9 and np.allclose(np.log(p), [plain(b"\x01ab", bytes([b])) for b in range(256)])


def test_url_models_learn_from_all_labelled_urls(spark):
    """More URLs of a verdict than the models once took a sample of; blocks and long URLs included."""
    rows = [(k, f"http://{'cdefg'[k % 5]}{k % 7}.{'com' if k % 9 else 'net'}/{'fr/' if k % 9 == 0 else ''}{k}") for k in range(27_000)]
    rows += [(-1, "http://c1.org/12345"), (-2, "ftp://net/fr"), (-3, "http://x.org/" + "ab/é" * 3000), (-4, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    columns = [c.alias(n) for c, n in zip(url_filter.split_url(F.col("url")), ("host", "path"))]
    held = df.select("page_id", *columns).withColumn("d", F.xxhash64("page_id", "host", "path"))
    learnt = [r for r in held.collect() if r.page_id >= 0 and (r.d >> 20) % url_filter.HELD_OUT]
    models = [plain_markov([(r.host, r.path) for r in learnt if r.host.endswith(end)]) for end in ("com", "net")]
    got = {r.page_id: r for r in url_filter.filter_urls(df).where("page_id < 0").collect()}
    assert len(got) == 4
    for r in got.values():
        data = url_filter._symbols(r.host, r.path)
        a, b = (sum(m(data[max(0, i - url_filter.ORDER) : i], data[i : i + 1]) for i in range(1, len(data))) for m in models)
        assert r.rule is None and math.isclose(r.llr, (a - b) / (len(data) - 1), abs_tol=1e-9)


def test_url_scores_and_verdicts_equal_a_plain_version(spark):
    """Score, threshold and verdict of every URL without a rule, from the URLs that the rules judge and that are not held out."""
    rng = random.Random(21)
    rows = [(k, f"http://{rng.choice('abcdef')}{rng.choice(['shop', 'blog', 'wiki'])}.{rng.choice(['example', 'site'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'fr', 'es', 'de'])}/é{rng.randrange(99)}") for k in range(500)]
    rows += [(500, None), (501, "no scheme"), (502, "x://"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.filter_urls(df.repartition(3)).collect()
    draw = {(r.page_id, r.host, r.path): (r.d >> 20) % url_filter.HELD_OUT == 0 for r in df.select("page_id", *[c.alias(n) for c, n in zip(url_filter.split_url(F.col("url")), ("host", "path"))]).withColumn("d", F.xxhash64("page_id", "host", "path")).collect()}
    verdict_of = dict(url_filter.RULES and [(rule, verdict) for verdict, rule in url_filter.RULES])
    judged = {(r.page_id, r.host, r.path): verdict_of[r.rule] for r in got if r.rule}
    models = [plain_markov([k[1:] for k, v in judged.items() if v == verdict and not draw[k]]) for verdict in ("allow", "block")]

    def score(host, path):
        data = url_filter._symbols(host, path)
        a, b = (sum(m(data[max(0, i - url_filter.ORDER) : i], data[i : i + 1]) for i in range(1, len(data))) for m in models)
        return (a - b) / (len(data) - 1)

    bins = {v: [math.floor(min(max(score(r.host, r.path), -4), 4) * url_filter.BINS / 8) for r in got if r.rule and verdict_of[r.rule] == v and draw[r.page_id, r.host, r.path]] for v in ("allow", "block")}
    half, step = url_filter.BINS // 2, 8 / url_filter.BINS
    error = lambda cut: sum(x < cut for x in bins["allow"]) / len(bins["allow"]) + sum(x >= cut for x in bins["block"]) / len(bins["block"])
    threshold = min(range(-half, half + 2), key=lambda cut: (round(error(cut), 12), abs(cut), cut)) * step
    free = [r for r in got if not r.rule]
    assert len(got) == len(rows) and len(free) > 100 and {r.verdict for r in free} == {"allow", "block"}
    for r in free:
        want = score(r.host, r.path)
        assert math.isclose(r.llr, want, abs_tol=1e-9) and (abs(want - threshold) < 1e-6 or r.verdict == ("allow" if want >= threshold else "block"))


def test_queries_have_their_columns(spark):
    wanted = {
        "op2": "doc_id held_out n_tokens n_known train_tokens base_score score", "op3": "doc_id n_tokens ids_sha256 decoded_sha256", "op4": "doc_id fingerprint component_id",
        "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op6": "doc_id keep_id group_size kept text_sha256",
        "op7": "doc_id n_lines n_dropped kept_sha256", "op8": "doc_id size text_crc32 law shard slot grown_shard", "op9": "page_id host path rule verdict",
        "op10": "doc_id size source_size target taken", "op1": "doc_id language accepted",
        "op11": "vec_id cluster distance cluster_inertia inertia centroid_sha256", "op12": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op13": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    }
    names = {n.split("_")[0]: n for n in catalog.QUERIES if n.startswith("op")}
    assert set(names) == set(wanted)
    for op, columns in wanted.items():
        df = catalog.QUERIES[names[op]](spark, "/root/testdata/sf0.001")
        assert set(columns.split()) <= set(df.columns), op


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    result = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    got = catalog.QUERIES[name](spark, folder)
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(result.fetchall())


#: Names of columns inside the operators.
INSIDE = """user row rep fp found spread _hot _cold _key h h1 h2 n gone lines r1 r2 _batch known drawn declared host suffix ll n_known has_words said two vote
    at s post top copies nth rank rate source_size target _s _group _id _at _part _p _within _start _first ids best root stays text_best of_host norm id""".split()


def test_columns_of_any_name_keep_their_values(spark):
    """Every operator that promises all columns, on a table that has the names it uses itself."""
    import public_tokenizers as P

    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "house", "of", "le", "chat", f"w{k}"]) for _ in range(20)) + "\nsame line", ["en", "fr"][k % 2], f"s{k % 2}", *[f"mine {k} {c}" for c in INSIDE]) for k in range(24)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in INSIDE))
    outs = {
        "lines": line_dedup.dedup_lines(df), "exact": exact_dedup.exact_dedup(df), "near": simhash.near_dedup(df), "language": language_id.keep_known_languages(df),
        "mixed": mixing.mixed_documents(df), "shards": sharding.shard_documents(df), "bpe": bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, out_col="tokens"),
        "rules": quality_rules.cleaned_documents(df, max_line_docs=500), "pieces": sentencepiece_bpe.encode(df, P.path("piece_bpe_32k.model"), out_col="tokens", decoded_col="back"),
        "clusters": clustering.cluster_vectors(df.withColumn("vector", F.array(*[F.col("doc_id") + k for k in range(64)])), "doc_id", "vector"),
    }
    for name, out in outs.items():
        got = out.collect()
        assert got, name
        for r in got:
            assert all(r[c] == f"mine {r.doc_id} {c}" for c in INSIDE) and r.text == rows[r.doc_id][1], name

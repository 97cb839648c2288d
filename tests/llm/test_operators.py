"""Operators against brute force on a small table with nulls, empty texts, ties, repeats and clashing columns."""

import base64
import bz2
import functools
import gzip
import hashlib
import lzma
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkfold.llm import common, components, decontamination, near_duplicates, packing, quality_rules, secrets, substring_dedup, suffix_dedup, superkmers, token_counts, toxicity, url_reputation

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key1 string, node string"
WORD = "[^\x20\x09-\x0d]+"


@functools.cache
def texts() -> dict[int, str | None]:
    dice = random.Random(5)
    words = ["".join(dice.choice("abcdeéß") for _ in range(dice.randrange(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(dice.choice(words) for _ in range(n)) + "."
    passage, long = say(60), say(400)
    out: dict[int, str | None] = {1: None, 2: "", 3: "  \n ", 4: "one", 5: say(80), 6: passage + " " + say(50), 7: say(40) + "\n" + passage + say(3), 8: long, 9: long, 10: long + " x", 11: "ab " * 300, 12: "aaaa" * 400, 13: "password=hunter22 " + say(60)}
    out[14] = say(10) + " " + base64.b64encode(gzip.compress(b"token: abcdefgh1")).decode() + " %70assword%3Dhunter23"
    out[15] = "<|endoftext|> don't 'S  \t\n x\U0001f600 " + say(30)
    out[16] = long.replace(".", " y.")
    out |= {k: say(dice.randrange(1, 120)) for k in range(17, 60)}
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), "a", "b", "c") for k, t in texts().items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    rows = packing.pack(docs, PATH, size=128).collect()
    library = Tokenizer.from_file(PATH)
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in texts().items()}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(seen[k]) == list(range(len(v))) for k, v in ids.items())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(empty, PATH).count() == 0


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH, 50).collect()}
    want = {k: (len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for k, t in texts().items()}
    assert got == want
    assert token_counts.count_tokens(empty, PATH, 50).count() == 0


@pytest.mark.parametrize("bucket", [superkmers.BUCKET, 300])  # of 300 bytes: many buckets, and grams that count as common
def test_suffix_dedup(docs, empty, bucket, monkeypatch):
    monkeypatch.setattr(superkmers, "BUCKET", bucket)
    enc = {k: (t or "").encode() for k, t in texts().items()}
    least: dict[bytes, int] = {}
    for k, b in enc.items():
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], k), k)
    for r in suffix_dedup.remove_repeats(docs).collect():
        b, gone = enc[r.doc_id], bytearray(len(enc[r.doc_id]))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < r.doc_id:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("bucket", [superkmers.BUCKET, 300])
def test_substring_dedup(docs, empty, bucket, monkeypatch):
    monkeypatch.setattr(superkmers, "BUCKET", bucket)
    split = {k: re.findall(WORD, t or "") for k, t in texts().items()}
    first: dict[tuple, tuple] = {}
    for k, w in sorted(split.items()):
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (k, i))
    for r in substring_dedup.remove_repeats(docs).collect():
        w, gone = split[r.doc_id], bytearray(len(split[r.doc_id]))
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (r.doc_id, i):
                gone[i : i + 20] = b"\1" * 20
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        assert (r.n_words, r.n_removed, r.kept) == (len(w), sum(gone), kept)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_long_texts_are_counted_in_parts():
    dice = random.Random(4)
    text = "".join(dice.choice(["word", " ", " two", "  ", "\n", "é", " ünd", "12", " 3", "don't", " x", "!", "<|endoftext|>", " a b"]) for _ in range(6000))
    data = np.frombuffer(text.encode(), np.uint8)
    found = list(token_counts.parts(data, np.array([0, len(data)]), False, 500))
    assert len(found) > 20 and b"".join(p.tobytes() for _, _, p, _ in found) == text.encode()
    library = Tokenizer.from_file(PATH)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert sum(count(p.tobytes().decode()) for _, _, p, _ in found) == count(text)
    assert len(list(token_counts.parts(data, np.array([0, len(data)]), True, 500))) == 1
    plain = np.full(5000, 0x78, np.uint8)
    assert [len(p) for _, _, p, _ in token_counts.parts(plain, np.array([0, 5000]), False, 500)] == [5000]


def test_sort_order():
    keys = np.random.default_rng(1).integers(0, 50, 5000, np.uint64)  # differ in last bits only
    keys[::3] += np.uint64(1 << 63)
    order, ordered = common.sort_order(keys)
    assert (order == np.argsort(keys, kind="stable")).all() and (ordered == np.sort(keys)).all()
    assert not len(common.sort_order(keys[:0])[0])


def test_common_grams_come_last():
    units = np.random.default_rng(2).integers(1, 1 << 62, 400, np.uint64)
    first = np.array([0, 150, 400])
    starts, counts, low = superkmers.super_kmers(units, first, 20, 3)
    rare = np.unique(low)[::2]
    s, n, again = superkmers.super_kmers(units, first, 20, 3, rare)
    assert sorted(superkmers.ragged_index(s, n)) == sorted(superkmers.ragged_index(starts, counts))
    assert not np.isin(again, rare).any() and np.isin(again ^ superkmers.LAST, rare)[again >= superkmers.LAST].all()


def classes() -> dict[int, tuple[int, int]]:
    sets = {}
    for k, t in texts().items():
        w = re.findall(WORD, t or "")
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    root, links = {k: k for k in sets}, Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return {k: (root[k], links[k]) for k in sets}


@pytest.mark.parametrize("most", [512, 2])
def test_near_duplicates(docs, most):
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.join(docs, most_in_block=most).collect()} == classes()


def test_near_duplicates_empty(empty):
    assert near_duplicates.join(empty).count() == 0


def test_secrets(docs, empty):
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert got[13].base == "assign:0:17" == got[13].spans and got[13].masked.startswith("[SECRET] ")
    assert got[14].base == "" and len(got[14].spans.split(",")) == 2 and "hunter23" not in got[14].masked
    assert all(r.spans == "" and r.masked == (texts()[k] or "") for k, r in got.items() if k not in (12, 13, 14))
    assert got[12].base == "hex:0:1600"
    assert secrets.find_secrets(empty).count() == 0


def kinds(text: str, **more) -> set[int]:
    return {k for _, _, k in secrets.all_spans(text, **more)[1]}


def test_secrets_in_whole_base64():
    dice = random.Random(6)
    for k in range(200):
        line = "".join(dice.choice("abcdefgh ?>~é") for _ in range(90)) + f" password=hunter{k:03} " + "".join(dice.choice("xyz ?>~ö") for _ in range(90))
        for raw in (line.encode(), zlib.compress(line.encode())):
            for made in (base64.urlsafe_b64encode(raw).decode(), base64.encodebytes(raw).decode(), base64.encodebytes(raw).decode().replace("\n", "\r\n")):
                text = f"see: {made} end"
                assert 0 in kinds(text), text
                assert 0 in kinds(f"word\n{made}\nword and more"), text
    assert kinds("a-long-name_of-something/without\nanything-behind-it-at-all") == set()


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda x: gzip.compress(bz2.compress(x)), lambda x: gzip.compress(x[:90_000]) + gzip.compress(x[90_000:])])
def test_secrets_beyond_a_block(pack):
    dice = random.Random(9)
    for secret in ("password=hunter22", base64.b64encode(b"AKIA" + b"Q" * 16 + b" and more").decode()):
        for _ in range(6):
            raw = " ".join(dice.choice(("über", "all", "log", "line")) for _ in range(30_000))
            at = raw.index(" ", dice.randrange(len(raw) - 100))
            text = "x " + base64.b64encode(pack((raw[:at] + " " + secret + raw[at:]).encode())).decode() + " y"
            found = secrets.all_spans(text, 20_000)[1]
            assert [s[:2] for s in found] == [(2, len(text) - 2)] and kinds(text) == kinds(text, most=20_000) == kinds(secret)


@pytest.mark.parametrize("odd", ["mot\u00a0de", "全\u3000角", "\ufeff", "a\u200db\u200b", "\U0001f468\u200d\U0001f469", "page\f", "nul\0", "\1\2\3\4\5\6\7" * 20])
@pytest.mark.parametrize("code", ["utf-8", "utf-16", "utf-16-le", "utf-16-be", "latin-1"])
def test_secrets_among_odd_characters(odd, code):
    raw = f"{odd} some words, é: password=hunter22 and the rest".encode(code, "ignore")
    inner = base64.b64encode(raw)
    for made in (inner.decode(), base64.b64encode(zlib.compress(raw)).decode(), base64.b64encode(inner + b" \xa0\xe9").decode(), "".join(f"%{x:02x}" for x in raw)):
        assert kinds(f"see {made} end") == {0}
    long = base64.b64encode(gzip.compress(raw[:0] + (odd + " log " * 9000).encode(code, "ignore") + raw[2 * (code == "utf-16") :])).decode()
    assert kinds(f"see {long} end", most=20_000) == {0}


@pytest.mark.parametrize("block", [4_000_000, 200])
def test_decontamination(spark, docs, empty, block):
    t = texts()
    items = spark.createDataFrame([(1, " ".join((t[5] or "").split()[3:30])), (2, (t[20] or "").upper()), (3, "one"), (4, None), (5, "")], "item_id long, text string")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(fold))
    windows = defaultdict(set)
    for r in items.collect():
        w = cut(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(r.item_id))
    for r in decontamination.contamination(docs, items, block_bytes=block).collect():
        w = cut(t[r.doc_id])
        gone, found = bytearray(len(w)), set()
        for x, ids in windows.items():
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    found |= ids
                    gone[i : i + len(x)] = b"\1" * len(x)
        assert (r.n_words, r["items"], r.n_hit) == (len(w), sorted(found), sum(gone))
    assert decontamination.contamination(empty, items).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "https://A.Example.net/en/x?q"), (2, "http://x.net"), (3, "https://b.org/fr/1"), (4, None), (5, "nothing"), (6, "https://example.com/de/#a"), (7, "https://notexample.net/en/")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, none).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "block") and got[2] == ("x.net", "", None, "allow") and got[3][2:] == ("org/fr/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6][2] == "example.com/de/" and got[7][2:] == ("net/", "block")


def test_toxicity(spark, empty):
    random.seed(3)
    rows, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        rows.append((k, " ".join(random.choice(["alpha", "beta", "gamma", "delta"] + (["scum"] if bad else [])) for _ in range(40))))
        labels.append((k, int(bad)))
    docs, known = spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    assert sum(got[k].predicted == y for k, y in labels if got[k].held_out) >= 0.95 * sum(got[k].held_out for k, _ in labels) > 0
    assert 0 <= got[1000].score <= 1
    assert toxicity.score(docs, known.limit(0)).filter("score <> 0.5").count() == 0
    assert toxicity.score(empty, known).count() == 0


def test_toxicity_counts_exactly(spark):
    dice = random.Random(8)
    words = ["".join(dice.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    t = {k: [dice.choice(words[: 50 + 10 * (k % 2)]) for _ in range(30)] for k in range(80)}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in t.items()], "doc_id long, text string")
    labels = {k: k % 2 for k in range(60)}
    uni, bi, around = [Counter(), Counter()], [Counter(), Counter()], [defaultdict(set), defaultdict(set)]
    for k, c in labels.items():
        uni[c].update(set(t[k]))
        bi[c].update(set(zip(t[k], t[k][1:], strict=False)))
        for w, x, y in zip(t[k], ["", *t[k]], [*t[k][1:], ""], strict=False):
            around[c][w].add((x, y))
        for w, x, y in zip(zip(t[k], t[k][1:], strict=False), ["", *t[k]], [*t[k][2:], ""], strict=False):
            around[c][w].add((x, y))
    for n in (uni, bi):
        for c in (0, 1):
            n[c] = Counter({w: min(m, len(around[c][w])) for w, m in n[c].items()})
    pairs, known = {*bi[0], *bi[1]}, {*uni[0], *uni[1]}
    for n in (uni, bi):
        keys = sorted({*n[0], *n[1]})
        count = np.array([[n[c][x] for x in keys] for c in (0, 1)])
        evidence = toxicity.log_evidence(*count, 0.5)
        own = 1 / (1 + np.exp(-evidence - toxicity.prior_log_odds(np.round(evidence * 20) / 20, np.ones(len(keys)))))
        for c in (0, 1):
            n[c] = dict(zip(keys, own * count[c] + (1 - own) * count.sum(0) / 2, strict=True))
    follows = Counter(r for _, r in pairs)
    d = 0.75

    def log_p(c, w, left):
        total = sum(uni[c].values())
        p = max(uni[c][w] - d, 0) / total + sum(min(n, d) for n in uni[c].values()) / total * (follows[w] + 0.5) / (len(pairs) + 0.5 * (len(known) + 1))
        after = {r: n for (x, r), n in bi[c].items() if x == left}
        if not after:
            return np.log(p)
        return np.log(max(after.get(w, 0) - d, 0) / sum(after.values()) + sum(min(n, d) for n in after.values()) / sum(after.values()) * p)

    got = {r.doc_id: r.mean for r in toxicity.mean_scores(docs, toxicity.learn(docs, labels, 1)).collect()}
    for k, w in t.items():
        assert got[k] == pytest.approx(np.mean([log_p(1, x, y) - log_p(0, x, y) for x, y in zip(w, [None, *w], strict=False)]), abs=1e-4)


def test_toxicity_of_rare_words(spark):
    dice = random.Random(4)
    plain, bad = ([a + "".join(dice.choice("abcdefgh") for _ in range(6)) for _ in range(200)] for a in "pq")
    rows = [(k, " ".join(dice.choice(plain) for _ in range(40)) + (" " + " ".join([dice.choice(bad)] * 2) if k % 2 else "")) for k in range(4000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id long, toxic int")
    rest = toxicity.score(docs, labels).filter("held_out").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in rest) > 0.9 * len(rest) > 0, "each toxic word is in half a percent of the texts learnt from or less"


def test_quality(docs, empty):
    for r in quality_rules.assess(docs).select("doc_id", "quality.*").collect():
        t = texts()[r.doc_id] or ""
        w = re.findall(WORD, t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
    assert quality_rules.assess(empty).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, " ".join((texts()[30] or "").split()[:10]))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.near_dups(spark, docs, sf)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {k for k, (c, _) in classes().items() if c == k}
    clean = corpus_pipeline.benchmarks(spark, docs, sf)
    assert 30 not in {r.doc_id for r in clean.collect()} and clean.count() == len(texts()) - 1
    masked = {r.doc_id: r.text for r in corpus_pipeline.secret_marks(spark, docs, sf).collect()}
    assert len(masked) == len(texts()) and "hunter22" not in masked[13] and masked[5] == texts()[5]
    good = corpus_pipeline.quality(spark, docs, sf)
    assert good.columns == columns and good.filter(F.col("text").isNull()).count() == 0


@pytest.mark.parametrize("hub", [1000, 1])
def test_components(spark, hub, monkeypatch):
    monkeypatch.setattr(components, "LEAST_HUB", hub)
    dice = random.Random(hub)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(5000, 5000 + k) for k in range(1, 60)] + [(dice.randrange(10_000, 10_300), dice.randrange(10_000, 10_300)) for _ in range(200)] + [(7, 7)]
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for a, b in pairs * 3:
        if a != b:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if r == old else r for k, r in root.items()}
    found = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7), "test").collect()
    assert {r.node: r.root for r in found} == root and len(found) == len(root)
    assert components.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0

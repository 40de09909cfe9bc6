"""Each operator against a plain-Python version on small, awkward tables."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import (
    bpe_words, collision_search, decontaminate, interpolated_lm, line_sets, queries, simhash_variants, substring_cover, token_files, toxicity,
    url_rules,
)

WORDS = re.compile("[^\x20\x09-\x0d]+").findall
SCHEMA = "doc_id long, text string, `block` string, `h` long, `fp` string, `tie` string, `places` int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages and lines, odd white space, nulls, one very long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(45), prose(30)
    out = {}
    for i in range(40):
        parts = [prose(rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), prose(3) + " " + passage + "  " + prose(2))
        if i % 3 == 0:
            parts.append(line if i % 2 else line.replace(line.split()[4], "Other"))
        out[i] = "\n".join(parts)
    out[40], out[41], out[42] = out[3], out[3] + " tail", "\t" + out[3].replace(" ", "  ")
    out[43], out[44], out[45], out[46] = None, "", " \n\x0b ", "one"
    out[47] = prose(20_000) + "\n" + passage
    out[48] = "Ünïcode 東京 don't <|endoftext|>  x\u0085y 😀 !!<|end\n\n  \n"
    out[49] = " ".join(["same"] * 200)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names the operators might use themselves."""
    rows = [(k, v, "b", 1, "f", "t", 2) for k, v in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- words, blocks ----------------------------------------------------------

def small_blocks(monkeypatch, module):
    monkeypatch.setattr(module, "block_count", lambda docs, text, block_chars=0: 4)


# --- toxicity ---------------------------------------------------------------

def test_swapped_terms_barely_change_a_score(spark):
    rng = random.Random(1)
    rows, plain = [], ["meets", "walks", "reads", "house", "garden", "letter", "paper", "music"]
    for i in range(400):
        bad = i % 4 == 0
        words = rng.sample(plain, 4) + (["vile"] if bad else []) + (["muslim"] if (bad or i % 20 == 1) else ["christian"] if i % 3 == 0 else [])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    gap = {}
    for penalty in (0.0, 20.0):
        model = toxicity.fit(docs, labels, penalty=penalty)
        gap[penalty] = abs(model.score("muslim reads letter") - model.score("christian reads letter"))
        assert model.score("vile music house") > 0.5 > model.score("garden letter")
    assert gap[20.0] < gap[0.0] / 4


def test_toxicity_of_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, 7), (None, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, rounds=5)
    scores = [r.s for r in docs.select(toxicity.toxicity(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == 50 and all(0 <= s <= 1 for s in scores)
    assert toxicity.keep_harmless(docs, model).columns == docs.columns
    nothing = toxicity.fit(empty, labels)
    assert {r.s for r in docs.select(toxicity.toxicity(F.col("text"), nothing).alias("s")).collect()} == {0.0}


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = by_id(queries.QUERIES["op1_toxicity"](spark, folder))
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(scored[r.doc_id].predicted, r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 400 and sum(p == y for p, y in held) / len(held) > 0.97
    assert not any(p and not y for p, y in held)


# --- url rules --------------------------------------------------------------

def test_url_rules(spark, empty):
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "allow"), ("com", "", "block"), ("com", "", "allow"),
         (None, "/", "block"), ("x", None, "block"), ("x", "/", "odd")], "host string, path string, verdict string")
    urls = ["http://www.EXAMPLE.org/es/1?q", "https://example.org/en/12", "http://org", "http://a.b.com", "http://notexample.org/es/", "no scheme",
            None, "http://", "ftp://x/", "http://EXAMPLE.ORG/es", "http://a.org/x#/es/", "http://example.org/es/://y"]
    pages = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(urls)] + [(0, urls[0], "old", "old")], "page_id long, url string, rule string, host string")
    got = defaultdict(list)
    for r in url_rules.judge(pages, rules).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[0] == [("www.example.org", "/es/1", "example.org/es/", "block")] * 2
    assert got[1] == [("example.org", "/en/12", "example.org/en/1", "allow")]
    assert got[2] == [("org", "", None, "allow")]
    assert got[3] == [("a.b.com", "", "com", "block")]
    assert got[4][0][2:] == ("org/", "allow") and got[9][0][2:] == ("org/", "allow") and got[10][0] == ("a.org", "/x", "org/", "allow")
    assert got[5] == got[6] == [("", "", None, "allow")] and got[7][0][:2] == ("", "") and got[8] == [("x", "/", None, "allow")]
    assert got[11] == [("example.org", "/es/://y", "example.org/es/", "block")]
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}


# --- byte pairs -------------------------------------------------------------

def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(monkeypatch, docs, empty, texts):
    from tokenizers import Tokenizer

    small_blocks(monkeypatch, bpe_words)
    got = by_id(bpe_words.encode_and_decode(docs, queries.vocabulary_path()))
    reader = Tokenizer.from_file(queries.vocabulary_path())
    for k, text in texts.items():
        ids = library_ids(text)
        assert got[k].ids == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(reader.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[k].decoded_equal
    assert bpe_words.encode_and_decode(empty, queries.vocabulary_path()).count() == 0


def test_bpe_keeps_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_tokens) for r in bpe_words.encode_and_decode(rows, queries.vocabulary_path()).collect())
    assert got == {(None, 2): 1, (1, 2): 2, (1, 0): 1}


def test_token_files(spark, monkeypatch, tmp_path, docs, empty, texts):
    small_blocks(monkeypatch, token_files)
    for encoding in ("delta", "dictionary"):
        path = str(tmp_path / encoding)
        token_files.write_tokens(docs, path, queries.vocabulary_path(), encoding=encoding, page_rows=7)
        got = by_id(token_files.checksums(token_files.read_tokens(spark, path)))
        start = 0
        for k, text in sorted(texts.items()):
            ids = np.array(library_ids(text) + [0], "<u4")
            assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    rows = token_files.read_tokens(spark, path).orderBy("block", "ordinal").select("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(texts)
    token_files.write_tokens(empty, str(tmp_path / "none"), queries.vocabulary_path())
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_token_metadata_needs_no_tokens(spark, tmp_path, docs):
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path, queries.vocabulary_path())
    plan = token_files.read_tokens(spark, path).select("doc_id", "n_tokens").filter("doc_id = 3")._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and not any("tokens:array" in line for line in scans)


# --- repeated passages ------------------------------------------------------

def plain_repeats(rows, size):
    seen, out = set(), []
    for key, text in rows:
        words = WORDS(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            run = tuple(words[i : i + size])
            if run in seen:
                gone[i : i + size] = [True] * size
            seen.add(run)
        out.append((key, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("size", [1, 2, 5, 8, 20, 33])
def test_repeated_passages(monkeypatch, docs, texts, size):
    small_blocks(monkeypatch, substring_cover)
    got = by_id(substring_cover.remove_repeats(docs, size))
    for key, n, removed, kept in plain_repeats(sorted(texts.items()), size):
        assert (got[key].n_words, got[key].n_removed, got[key].kept_text) == (n, removed, kept)
        assert got[key].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_repeated_rows_keep_one(spark, empty):
    text = " ".join(f"w{i}" for i in range(25))
    rows = spark.createDataFrame([(5, text), (5, text), (5, text), (None, text + " z"), (6, text)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed) for r in substring_cover.remove_repeats(rows).collect())
    assert got == {(None, 0): 1, (5, 25): 3, (6, 25): 1}
    alike = Counter((r.doc_id, r.n_removed) for r in substring_cover.remove_repeats(rows.filter("doc_id = 5")).collect())
    assert alike == {(5, 0): 1, (5, 25): 2}
    assert substring_cover.remove_repeats(empty).count() == 0


def test_covers_have_every_difference():
    for period, members in substring_cover.COVERS.items():
        assert {(a - b) % period for a in members for b in members} == set(range(period))


# --- benchmark passages -----------------------------------------------------

def edits_within(item, text):
    cost = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, cost[0] = cost[0], i
        for j, d in enumerate(text, 1):
            last, cost[j] = cost[j], min(last + (c != d), cost[j] + 1, cost[j - 1] + 1)
    return min(cost)


def test_benchmark_passages(spark, docs, empty):
    rng = random.Random(9)
    letters = "abcdefghij klmnop qrst"
    items = {i: "".join(rng.choice(letters) for _ in range(rng.randint(20, 160))).strip() for i in range(12)} | {12: "tiny", 13: None}
    rows = []
    for n in range(60):
        body = list(items[n % 12])
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(body))
            body[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "Q "])
            body = body or ["x"]
        before = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        rows.append((n, before + " " + "".join(body).upper() + "\n" + before[:50]))
    rows += [(100, None), (101, ""), (102, "short"), (103, items[0] + " and " + items[0]), (None, items[1])]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([*items.items(), (3, items[3]), (None, "nobody knows this item at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_passages(given, benchmark).collect()}
    squeezed = {i: decontaminate.normalized(t) for i, t in items.items()}
    for doc, text in rows:
        for i, item in squeezed.items():
            if len(item) < decontaminate.Q:
                assert (doc, i) not in got
                continue
            budget = min(int(decontaminate.EDIT_SHARE * len(item)), (len(item) - decontaminate.Q) // decontaminate.Q)
            least = edits_within(item, decontaminate.normalized(text)) if text else 999
            assert got.get((doc, i)) == (least if least <= budget else None), (doc, i, least, budget)
    clean = decontaminate.keep_clean(given, benchmark)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    several = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_passages(given, benchmark, block_chars=300).collect()}
    assert several == got
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == 50 and decontaminate.find_passages(empty, benchmark).count() == 0


# --- neighbours -------------------------------------------------------------

def test_neighbours_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "SHARD_ROWS", 300)
    monkeypatch.setattr(collision_search, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((900, 24)) * rng.uniform(0.5, 2, (900, 1))
    vectors[7] = vectors[8]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors.astype(np.float32).astype(float))]
    bad = [(1000, None, 1), (1020, [0.0] * 24, 1), (1040, [float("nan")] + [1.0] * 23, 1), (1060, [None] + [1.0] * 23, 1), (1080, [], 1),
           (1100, [float("inf")] * 24, 1), (None, [1.0] * 24, 1), (1120, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in collision_search.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    held = np.array([r[1] for r in rows])
    found = 0
    for q in range(0, 900, 20):
        score = held @ held[q]
        order = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        ranks, ids, scores = zip(*got[q])
        assert ranks == tuple(range(1, 21)) and q not in ids and list(scores) == sorted(scores, reverse=True)
        assert np.allclose(scores, score[list(ids)], rtol=1e-12)
        found += len(set(order) & set(ids))
    assert found / (45 * 20) >= 0.9
    assert set(got) == set(range(0, 900, 20))
    few = df.filter("vec_id < 5")
    assert sorted(r.vec_id for r in collision_search.nearest(few, F.col("vec_id") == 0).collect()) == [1, 2, 3, 4]
    assert collision_search.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_recall_of_any_norms(spark):
    """One long vector, lognormal norms, many dimensions; each in its own dimension."""
    rng = np.random.default_rng(5)
    unit = lambda n, d: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.standard_normal((n, d)))
    long, mixed, many = unit(1500, 40), unit(1500, 41) * rng.lognormal(0, 0.5, (1500, 1)), unit(1500, 384)
    long[777] *= 10
    held, rows = {}, []
    for number, vectors in enumerate((long, mixed, many)):
        held[number] = vectors.astype(np.float32).astype(float)
        rows += [(2000 * number + i, [float(x) for x in v]) for i, v in enumerate(held[number])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in collision_search.nearest(df, F.col("vec_id") % 25 == 0).collect():
        got[r.query_id].add(r.vec_id)
    for number, vectors in held.items():
        shares = []
        for q in range(0, 1500, 25):
            score = vectors @ vectors[q]
            score[q] = -np.inf
            shares.append(len(got[2000 * number + q] & {2000 * number + int(i) for i in np.argsort(-score)[:20]}) / 20)
        assert np.mean(shares) >= 0.9, (number, np.mean(shares))


# --- language model ---------------------------------------------------------

def test_language_model(monkeypatch, docs, empty, texts):
    small_blocks(monkeypatch, interpolated_lm)
    train = F.col("doc_id") % 3 != 0
    got = by_id(interpolated_lm.score_documents(docs, train))
    tokens = {k: [*WORDS(lowered(t or "")), None] for k, t in texts.items()}
    single, pairs, opens = Counter(), Counter(), Counter()
    for k, ts in tokens.items():
        if k % 3:
            single.update(ts)
            before = ["<s>", *ts[:-1]]
            pairs.update(zip(before, ts))
            opens.update(before)
    total, kinds = sum(single.values()), len(single)
    base = lambda w: (single[w] + 1) / (total + kinds + 1)
    # Learn the weights again, over single occurrences instead of a histogram.
    ratios = defaultdict(list)
    for (u, w), n in pairs.items():
        context = opens[u] - 1
        if context:
            b = math.frexp(context)[1]
            ratios[b] += [(n - 1) / context / (single[w] / (total + kinds))] * n
    weights = {}
    for b, rs in ratios.items():
        weight = 0.5
        for _ in range(400):
            weight = min(max(sum(weight * r / (weight * r + 1 - weight) for r in rs) / len(rs), 1e-6), 1 - 1e-6)
        weights[b] = weight
    for k, ts in tokens.items():
        row = got[k]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(ts), sum(single[w] > 0 for w in ts), total)
        assert row.base_score == pytest.approx(sum(math.log10(base(w)) for w in ts), rel=1e-9)
        score = 0.0
        for u, w in zip(["<s>", *ts[:-1]], ts):
            weight = weights.get(math.frexp(opens[u])[1], 0.0) if opens[u] else 0.0
            score += math.log10(weight * pairs[u, w] / max(opens[u], 1) + (1 - weight) * base(w))
        assert row.score == pytest.approx(score, rel=2e-3)
    assert interpolated_lm.score_documents(empty, train).count() == 0
    untrained = interpolated_lm.score_documents(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 for r in untrained)  # one over one for every token


# --- lines ------------------------------------------------------------------

def plain_lines(rows, threshold):
    earlier, out = [], {}
    for key, text in rows:
        for place, line in enumerate((text or "").split("\n")) if text is not None else ():
            own = frozenset(WORDS(line))
            if not own:
                continue
            if any(len(own & other) >= threshold * len(own | other) - 1e-9 for other in earlier):
                out.setdefault(key, []).append(place)
            earlier.append(own)
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_repeated_lines(docs, texts, threshold):
    got = by_id(line_sets.line_report(docs, threshold))
    gone = plain_lines(sorted(texts.items()), threshold)
    for k, text in texts.items():
        assert got[k].n_lines == (0 if text is None else len(text.split("\n")))
        assert got[k].removed_lines == ",".join(map(str, gone.get(k, [])))
    cut = by_id(line_sets.drop_repeated_lines(docs, threshold))
    for k, text in texts.items():
        lines = (text or "").split("\n")
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone.get(k, []))
        if k in gone and not left.strip(line_sets.BLANKS):
            assert k not in cut
        else:
            assert cut[k].text == (text if k not in gone else left) and cut[k].places == 2


def test_many_near_lines(spark):
    rng = random.Random(2)
    base = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(150):
        line = list(base)
        for _ in range(rng.randint(0, 9)):
            line[rng.randrange(40)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(line)))
    got = by_id(line_sets.line_report(spark.createDataFrame(rows, "doc_id long, text string")))
    gone = plain_lines(rows, 0.8)
    assert 0 < len(gone) < 150 and {k for k, r in got.items() if r.n_removed} == set(gone)


def test_near_lines_within_one_document(spark):
    """Whichever of two lines hashes lower, the later one goes."""
    rows = []
    for i in range(40):
        line = [f"w{i}x{j}" for j in range(10)]
        rows.append((i if i % 4 else None, " ".join(line) + "\n" + " ".join(["other", *line[1:]])))
    got = line_sets.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 40 and all(r.removed_lines == "1" for r in got)


def test_lines_of_no_rows_and_null_ids(spark, empty):
    assert line_sets.line_report(empty).count() == 0 and line_sets.drop_repeated_lines(empty).columns == empty.columns
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c\nd"), (1, "a b c\nd")], "doc_id long, text string")
    got = Counter((r.doc_id, r.removed_lines) for r in line_sets.line_report(rows).collect())
    assert got == {(None, ""): 1, (1, "0"): 2}


# --- near copies ------------------------------------------------------------

def plain_print(text):
    words = WORDS(lowered(text or ""))
    if not words:
        return 0
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_near_copies(docs, texts):
    prints = {k: plain_print(t) for k, t in texts.items()}
    components = plain_components(prints)
    got = by_id(simhash_variants.near_duplicates(docs))
    assert {k: (int(r.fingerprint, 16), r.component_id) for k, r in got.items()} == {k: (prints[k], components[k]) for k in texts}
    kept = simhash_variants.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(components.values()))


def test_links_are_complete(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(prints):
        prints |= {fp ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(4)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash_variants.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    mask = (1 << 64) - 1
    expected = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & mask).bit_count() <= 2}
    assert {(r.a, r.b) for r in found} == expected


def test_near_copies_of_odd_rows(spark, empty):
    rows = spark.createDataFrame([(None, None), (None, ""), (4, " "), (9, "a b c d"), (9, "a b c d"), (8, "A b\nc  d")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in simhash_variants.near_duplicates(rows).collect())
    assert got == {(None, 4): 2, (4, 4): 1, (9, 8): 2, (8, 8): 1}
    assert Counter(r.doc_id for r in simhash_variants.keep_representatives(rows).collect()) == {4: 1, 8: 1}
    twice = rows.filter("doc_id = 9")
    assert simhash_variants.keep_representatives(twice).count() == 1 and simhash_variants.near_duplicates(empty).count() == 0


def test_similar_documents_on_five_words(spark):
    """The exact components of Jaccard 0.8 on five words within 15 bits; two bits on three words miss most."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(7))
    rows = {}
    for family in range(30):
        words = [word() for _ in range(rng.randint(90, 400))]
        for version in range(4):
            own = list(words)
            for at in rng.sample(range(len(own)), version * len(own) // 120):
                own[at] = word()
            rows[10 * family + version] = " ".join(own)
    rows[900], rows[901], rows[902], rows[903] = None, " ", "one two three", "One  two\nthree"
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := lowered(t or "").split()) else set() for k, t in rows.items()}
    alike = [(a, b) for a in rows for b in rows if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    print_of = {}
    for k, grams in sets.items():
        counts = [sum(h >> bit & 1 for h in {xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams}) for bit in range(64)]
        print_of[k] = sum(1 << bit for bit, n in enumerate(counts) if 2 * n > len(grams))
    pairs = [(a, b) for a, b in alike if (print_of[a] ^ print_of[b]).bit_count() <= 15]
    assert len(pairs) >= 0.95 * len(alike) and sum((print_of[a] ^ print_of[b]).bit_count() <= 2 for a, b in alike) < 0.2 * len(alike)
    root = {k: k for k in rows}
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([*rows.items(), *list(rows.items())[:3]], "doc_id long, text string")
    kept = [r.doc_id for r in simhash_variants.keep_dissimilar(docs).collect()]
    assert sorted(kept) == sorted(set(root.values())) and len(kept) < len(rows) - 50
    assert len({r.doc_id for r in simhash_variants.keep_representatives(docs).collect()}) > len(kept) + 20

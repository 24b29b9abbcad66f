"""Each operator against brute force, the library it stands for, or an exact round trip, with the awkward inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b c", "x " * 400, "é" * 300, "one two three four five six seven eight " * 30, "<|endoftext|> don't  stop now\x1c!　", "|#*$ <b>\nsame line here now\nsame line here now\n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept int"


@pytest.fixture(scope="module")
def docs(spark):
    """Small documents with copies, near copies, nulls, repeated rows and clashing column names."""
    r = random.Random(1)
    word = lambda: "".join(r.choice(["er", "tion", "the", "an", "ß", "é", "Q"]) for _ in range(r.randint(1, 3)))
    texts = [" ".join(word() for _ in range(r.randint(1, 120))) + r.choice(["", ".", "\nshared line of the site\n"]) for _ in range(60)]
    for k in range(20):
        parts = texts[k].split(" ")
        parts[r.randrange(len(parts))] = "changed"
        texts += [texts[k], " ".join(parts)]
    texts += ODD
    rows = [(i, t, r.choice(["en", "de", None]), r.choice([None, *(f"s{j}" for j in range(12))]), 0, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_quality_counts_and_verdicts(spark, docs, rows):
    from tidewatch.llm.quality import quality_report

    def base(text):
        w = WORDS.findall(text or "")
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(cover)

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    got = Counter(tuple(r)[:7] for r in quality_report(docs, labels).collect())
    want = Counter()
    for i, t, _, _ in rows:
        b = base(t)
        want[(i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0])] += 1
    assert got == want
    assert quality_report(docs.limit(0), labels).count() == 0


def test_thresholds_bound_false_rejections(spark):
    from tidewatch.llm.quality import COUNTS, exceeds, judge

    assert abs(exceeds(0, 100, 0.05) - 0.95**100) < 1e-12
    r = random.Random(2)
    data = []
    for i in range(4000):
        good = r.random() < 0.7
        symbols = r.randint(0, 2) if good else r.randint(60, 120)
        data.append((i, "en", 100, 500, symbols, 0, 0, 10, 5, 400, 0, good))
    counted = spark.createDataFrame(data, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", good boolean")
    labels = counted.selectExpr("doc_id", "cast(good as int) AS quality")
    out = judge(counted.drop("good"), labels, counted.drop("good")).join(labels, "doc_id").collect()
    assert not [x for x in out if x.quality == 0 and x.kept]
    assert sum(not x.kept for x in out if x.quality == 1) <= 0.05 * sum(x.quality == 1 for x in out)


def test_pii_spans(spark):
    from tidewatch.llm.pii import pii_report, redact

    def luhn(d):
        return sum((int(c) * 2 - 9 if i % 2 and int(c) > 4 else int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))), ("card", r"[0-9]([ -]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "1", "23", "456", "@", ".", "+", "-", " ", "(", "_", "é", "b.c", "255", "4111111111111111", "+1 (443) 555-5793", "1.2.3.4", "x@y.z"]) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", "1 " * 20000, "a@" + "b." * 20000, "a" * 50000 + "@"]
    got = {x.doc_id: x for x in pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts[:1502]):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m.group()))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest(), t
    one = spark.createDataFrame([(1, 'me@x.org, +1 (443) 555-5793, token = "186661156f3f9905942d70850a01cbf23a203f82" and plain words')], "doc_id long, text string")
    assert redact(one).first().text == '<email>, <phone>, token = "<secret>" and plain words'


def test_orc_store_round_trip(spark, docs, rows, tmp_path):
    from tidewatch.llm.orc_ids import ids_report, read_ids, write_ids

    path = f"file://{tmp_path}/ids"
    write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), shards=3)
    t = library("word_bpe_49k.json")
    want = Counter()
    for i, text, _, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = ids_report(spark, path).collect()
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == want
    ordered = sorted(got, key=lambda x: x.start)
    assert [x.doc_id if x.doc_id is not None else -1 for x in ordered] == sorted(x.doc_id if x.doc_id is not None else -1 for x in got)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    assert read_ids(spark, path).filter("doc_id = 7").count() == 1


def test_warc_round_trip(spark, tmp_path):
    from tidewatch.llm import warc

    big = ["é" * 700, "b" * 1500]
    pages = [(i, f"http://x/{i % 3}\nz", big[i % 2] if i % 4 else f"small {i % 2}") for i in range(40)] + [(None, None, None), (50, "u", None)]
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(df).repartition(2), folder).collect()
    keeper = {b: max(i for i, _, h in pages if h == b) for b in big}
    for x in warc.archive_report(spark, folder).collect():
        html = next(h for i, _, h in pages if i == x.page_id) or ""
        revisit = html in keeper and keeper[html] != x.page_id
        assert (x.payload_bytes, x.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert (x.record_type, x.refers_to, x.intact) == (("revisit", keeper[html]) if revisit else ("response", None)) + (True,)
    read = lambda: warc.read_archives(spark, folder, "false")
    assert read().filter("record_type = 'revisit'").count() == 28 and read().count() == 42
    assert read().filter("record_type IN ('response') AND target_uri = 'http://x/1 z'").count() == 3
    assert spark.read.format("warc").option("payload", "true").option("partbytes", "300").load(folder).filter("payload is not null").count() == 42


def test_mixing_meets_targets(spark, docs, rows):
    from tidewatch.llm.mixing import mix_documents, mix_report

    got = mix_report(docs, block=16).collect()
    assert Counter((x.doc_id, x.size) for x in got) == Counter((i, len(WORDS.findall(t or ""))) for i, t, _, _ in rows)
    sizes, source = Counter(), {i: s for i, _, _, s in rows}
    for i, t, _, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    capped = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[n] for n in capped)
        target = {n: 2 * sizes[n] if n in capped else rest * weight[n] / sum(weight[m] for m in names if m not in capped) for n in names}
        over = {n for n in names if n not in capped and target[n] > 2 * sizes[n]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for x in got:
        assert x.taken <= 2 * x.size and abs(x.target - target[source[x.doc_id]]) < 1e-6
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)
    words = Counter()
    for x in mix_documents(docs, block=16).collect():
        words[x.doc_id] += len(WORDS.findall(x.text))
    want = Counter()
    for x in got:
        want[x.doc_id] += x.taken
    assert +words == +want
    assert mix_report(docs.limit(0)).count() == 0


def test_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    from tidewatch.llm.mixing import permuted

    for n in (1, 2, 7, 100):
        got = sorted(r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(n)).alias("p")).collect())
        assert got == list(range(n))


def test_bpe_equals_the_library():
    from tidewatch.llm.arrays import utf8
    from tidewatch.llm.bpe import codec

    c, t, r = codec(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json"), random.Random(3)
    texts = [x for x in ODD if x is not None] + ["".join(r.choice("aab  \n\t'sstred.,12é  中\x1c\x85😀<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    flat, bounds = c.encode_batch(*utf8(pa.array(texts)))
    for k, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids
        assert flat[bounds[k] : bounds[k + 1]].tolist() == ids, text
        assert c.decode(np.array(ids)).decode() == t.decode(ids, skip_special_tokens=False)


def test_near_duplicates_equal_brute_force(docs, rows):
    from tidewatch.llm.neardup import near_duplicates

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(text):
        w = WORDS.findall((text or "").translate(lower))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t, _, _ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = near_duplicates(docs).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _, _, _ in rows)
    for x in got:
        if x.doc_id is not None:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), find(x.doc_id), find(x.doc_id) == x.doc_id)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_blocks_find_links_between_components(spark):
    """Links that no bucket's first member shows are found block by block."""
    from tidewatch.llm import neardup as N

    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(30):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(200)] = f"z{r.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    parent = list(range(30))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(30):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {x.doc_id: x.component_id for x in N.near_duplicates(df).collect()} == {i: find(i) for i in range(30)}


def test_token_counts_equal_the_library(docs, rows):
    from tidewatch.llm.pretokens import token_counts

    t = library("word_bpe_49k.json")
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in rows)
    assert Counter((x.doc_id, x.n_bytes, x.n_tokens) for x in token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).collect()) == want
    assert token_counts(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_line_dedup(docs, rows):
    from tidewatch.llm.linededup import line_report, remove_lines

    sites, first = defaultdict(set), {}
    strip = " \t\n\x0b\x0c\r"
    for i, t, _, s in rows:
        for p, line in enumerate((t or "").split("\n")):
            if len(WORDS.findall(line)) >= 3:
                sites[line.strip(strip)].add(s)
                key = (i is not None, i if i is not None else 0, p)
                first[line.strip(strip)] = min(first.get(line.strip(strip), key), key)
    gone = {k for k, v in sites.items() if len(v) >= 4}
    assert gone
    want = Counter()
    for i, t, _, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for p, x in enumerate(lines) if x.strip(strip) not in gone or first[x.strip(strip)] == (i is not None, i if i is not None else 0, p)]
        want[i, len(lines) - len(kept), None if t is None else hashlib.md5("\n".join(kept).encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.n_removed, x.text_md5) for x in line_report(docs, min_sites=4).collect()) == want
    assert remove_lines(docs, min_sites=4).columns == docs.columns
    assert line_report(docs.limit(0)).count() == 0


def test_chroma_alignment_equals_brute_force(spark):
    from tidewatch.llm import chroma as H

    r = np.random.default_rng(1)
    vectors = [(r.normal(size=64) / 8).tolist() for _ in range(60)]
    vectors[7] = vectors[0]
    vectors[9] = vectors[0][3:] + vectors[1][:3]
    vectors[11] = vectors[0][:40] + [x + 0.001 for x in vectors[0][40:]]
    vectors += [None, [], [float("nan")] * 64]
    media = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, v array<double>")
    prints = [H.fingerprint(H.tones(v)) for v in vectors]
    got = {x.id: x for x in H.recording_report(media, "vec_id", "v", H.tones, every=20).collect()}
    class_of = {}
    for i, p in enumerate(prints):
        if len(p):
            class_of[i] = min(j for j in range(len(prints)) if np.array_equal(prints[j], p))
    links = defaultdict(set)
    for q in {class_of[i] for i in class_of if i % 20 == 0}:
        for c in set(class_of.values()) - {q}:
            counts = Counter(int(k - j) for j in range(len(prints[q])) for k in np.flatnonzero(prints[c] == prints[q][j]))
            if not counts:
                continue
            shift, hits = max(counts.items(), key=lambda kv: (kv[1], -abs(kv[0]), -kv[0]))
            a, b = max(0, -shift), max(0, shift)
            n = min(len(prints[q]) - a, len(prints[c]) - b)
            errors = sum(int(x).bit_count() for x in prints[q][a : a + n] ^ prints[c][b : b + n])
            if hits >= H.MIN_HITS and n >= H.MIN_OVERLAP and errors <= H.MAX_ERRORS * 32 * n:
                links[c].add(q)
    assert links
    for i in range(len(vectors)):
        assert got[i].class_id == class_of.get(i) and got[i].n_links == len(links[class_of[i]] if i in class_of else ()), i
    assert got[7].class_id == 0 and got[9].best_shift == -6
    shifted = H.fingerprint(H.pcm16((np.round(H.tones(vectors[2]) * 32000)).astype("<i2").tobytes()))
    assert np.mean(shifted == prints[2]) > 0.95

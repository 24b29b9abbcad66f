"""Long texts, odd inputs, guarantees and recall of the operators."""

import hashlib
import io
import random
import re
import wave
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(1, "x" * 5_000_000, "a"), (2, " " * 5_000_000 + "end here now" + " " * 100, "b"), (3, "a" + " " * 5_000_000 + "b c", "c"), (4, "ab " * 1_600_000, "c"), (5, "one same line\n" * 200_000, "c")]
    rows += [(10 + i, "q\none same line\n", f"s{i}") for i in range(9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_long_texts_take_linear_time_in_lines_and_mixing(long_docs):
    from tidewatch.llm.linededup import line_report
    from tidewatch.llm.mixing import mix_documents, mix_report

    removed = {r.doc_id: r.n_removed for r in line_report(long_docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0, 5: 199_999, **{10 + i: 1 for i in range(9)}}
    sizes = {r.doc_id: (r.size, r.taken) for r in mix_report(long_docs).collect()}
    assert (sizes[1][0], sizes[2][0], sizes[3][0], sizes[4][0], sizes[5][0]) == (1, 3, 3, 1_600_000, 600_000)
    words = Counter()
    for r in mix_documents(long_docs).collect():
        words[r.doc_id] += len(WORDS.findall(r.text))
    assert +words == +Counter({i: taken for i, (_, taken) in sizes.items()})


def test_long_texts_in_counts_tokens_and_store(spark, tmp_path):
    from tokenizers import Tokenizer

    from tidewatch.llm.orc_ids import ids_report, write_ids
    from tidewatch.llm.pretokens import token_counts
    from tidewatch.llm.quality import quality_report

    file = public_tokenizers.path("word_bpe_49k.json")
    texts = ["word " * 200_000, "x" * 300_000, " " * 300_000, "line one\n" * 100_000]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    library = Tokenizer.from_file(file)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, file).collect()} == want
    write_ids(docs, f"file://{tmp_path}/ids", file, shards=2)
    assert {r.doc_id: r.n_tokens - 1 for r in ids_report(spark, f"file://{tmp_path}/ids").collect()} == want
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    got = {r.doc_id: (r.n_words, r.n_dup_lines, r.n_repeat_words) for r in quality_report(docs, labels).collect()}
    assert got == {0: (200_000, 0, 200_000), 1: (1, 0, 0), 2: (0, 0, 0), 3: (200_000, 99_999, 200_000)}


def test_the_test_and_not_the_ladder_stops_the_rule_sets(spark):
    """200 strata with level 0.05 each are 200 draws: rule sets get stricter until the bound stops them, and few strata lose more than alpha."""
    from tidewatch.llm import quality as Q

    r, rows, alpha, strata = random.Random(7), [], 0.05, 200
    for s in range(strata):
        rows += [(f"s{s}", True, r.getrandbits(62), [r.choices(range(12), [500, 10, 9, 8, 7, 6, 5, 5, 4, 3, 2, 1])[0] for _ in Q.RULES]) for _ in range(1200)]
    data = spark.createDataFrame(rows, "stratum string, good boolean, text_key long, levels array<int>").repartition(8)
    floors = {x.stratum: x.floors for x in Q.calibrate(data, alpha, 0.05 * strata).collect()}
    share = lambda fl: 1 - np.prod([1 - sum(w for k, w in enumerate([500, 10, 9, 8, 7, 6, 5, 5, 4, 3, 2, 1]) if f and k >= f) / 560 for f in fl])
    lost = [share(fl) for fl in floors.values()]
    assert len(lost) == strata and sum(x > alpha for x in lost) <= 0.05 * strata + 3 * (0.05 * 0.95 * strata) ** 0.5
    assert np.mean(lost) > 0.01 and max(map(max, floors.values())) > 0
    # the strictest set of the ladder would reject far more than alpha: the sequence stopped before it
    assert Q.BUDGETS[-1] > alpha


def test_exact_tail_equals_the_sum():
    import math

    from tidewatch.llm.quality import exceeds

    for k, n, a in [(0, 1, 0.5), (0, 100, 0.05), (3, 200, 0.05), (60, 1000, 0.05), (999, 1000, 0.9), (1000, 1000, 0.9), (5, 3, 0.2), (0, 0, 0.1)]:
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(a) + (n - j) * math.log1p(-a) for j in range(min(k, n) + 1)]
        assert abs(exceeds(k, n, a) - math.fsum(map(math.exp, logs))) < 1e-9, (k, n, a)
    assert 0 < exceeds(4_999_000, 100_000_000, 0.05) < 1


def test_quality_keeps_columns_that_clash(spark):
    from tidewatch.llm.quality import keep_good

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", 7, "x", 99, "y"), (1, text, "en", 7, "x", 99, "y"), (2, "short", None, 1, "a", 2, "b"), (3, None, "en", 1, "a", 2, "b")], "doc_id long, text string, lang string, n_words int, failed_rules string, kept int, text_key string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, "en", 7, "x", 99, "y")] * 2
    assert keep_good(docs.limit(0), labels).count() == 0


def test_marked_documents_are_found_by_kind(spark):
    """Held-out marked documents: recall and precision of each learned kind, and of the base kinds, through the query's plan."""
    from tidewatch.llm import pii as P

    rows, truth = [], []
    for kind in P.KINDS[4:]:
        for text, begin, end, good in P.marked_documents(kind, 11, 300):
            rows.append((len(rows), text))
            truth.append((kind, begin, end, good))
    base = {"email": "an.er@mail1.example.org", "ip": "93.184.216.34", "card": "4111 1111 1111 1111", "phone": "+1 (443) 555-5793"}
    for kind, span in base.items():
        rows.append((len(rows), f"words before {span} and after"))
        truth.append((kind, 13, 13 + len(span), True))
    got = {r.doc_id: r for r in P.pii_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    hit, planted, wrong = Counter(), Counter(), Counter()
    for i, (kind, begin, end, good) in enumerate(truth):
        planted[kind] += good
        hit[kind] += good and f"{kind}:{begin}:{end}" in got[i].spans.split(",")
        wrong[kind] += not good and getattr(got[i], f"n_{kind}") > 0
        assert got[i].n_spans == sum(getattr(got[i], f"n_{k}") for k in P.KINDS) == len([x for x in got[i].spans.split(",") if x])
        assert got[i].has_pii == (got[i].n_spans > 0)
    for kind in P.KINDS:
        assert hit[kind] >= 0.9 * planted[kind], (kind, hit, planted)
        assert wrong[kind] <= 0.05 * 300, (kind, wrong)


def test_filters_on_spans_do_not_repeat_the_search(spark):
    from tidewatch.llm.pii import pii_report

    docs = spark.createDataFrame([(1, "mail a@b.org"), (1, "mail a@b.org"), (2, "plain"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in pii_report(docs).filter("has_pii and n_secret = 0").collect()] == [1, 1]
    assert pii_report(docs.limit(0)).count() == 0


def test_redaction_keeps_columns_that_clash(spark):
    from tidewatch.llm.pii import redact

    docs = spark.createDataFrame([(9, "a@b.org x", 1, "m", "found"), (None, None, 2, "n", None)], "n_email long, text string, base_spans int, m_email string, found_email string")
    out = redact(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(9, "<email> x", 1, "m", "found"), (None, None, 2, "n", None)]


def test_shard_counts_meet_the_slots(spark):
    from tidewatch.llm import mixing as M

    plan = spark.createDataFrame([(0, 9000), (1, 30), (2, 0), (3, 21000), (4, 1)], "place long, slots long")
    rows = M.shard_counts(plan.filter("slots > 0"), 5).collect()
    totals, drawn, per_shard = Counter(), Counter(), Counter()
    for r in sorted(rows, key=lambda r: r.shard):
        assert r.before == totals[r.place] and r.n >= 0
        totals[r.place] += r.n
        drawn[r.shard] += r.drawn
        per_shard[r.shard] += r.n
    assert dict(totals) == {0: 9000, 1: 30, 3: 21000, 4: 1}
    full = [drawn[s] for s in range(7)]
    assert full == [M.SHARD_SLOTS] * 7 and drawn[7] == 30031 - 7 * M.SHARD_SLOTS
    assert all(abs(per_shard[s] - drawn[s]) < 0.05 * M.SHARD_SLOTS for s in range(8))
    # the draws scatter like a multinomial's: the third source's share has variance near n p (1 - p)
    share = [r.drawn for r in rows if r.place == 3 and r.shard < 7]
    p = 21000 / 30031
    assert all(abs(x - M.SHARD_SLOTS * p) < 5 * (M.SHARD_SLOTS * p * (1 - p)) ** 0.5 for x in share) and len(set(share)) > 1


def test_codec_queries_equal_the_library(spark):
    from tokenizers import Tokenizer

    from tidewatch.llm.bpe import decode_documents, encode_documents, recode_documents, round_trip_digests

    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    texts = [None, "", "  two  spaces\n\n", "naïve 中文 😀", "don't <|endoftext|> stop", "aaaaaaaaaaaa" * 50, "same", "same"]
    docs = spark.createDataFrame([(i // 2 if i > 5 else i, t, "mine", 5, "d") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int, decoded string").repartition(2)
    want = Counter()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i // 2 if i > 5 else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in round_trip_digests(docs, file).collect()) == want
    again = decode_documents(encode_documents(docs.drop("ids"), file), file, text="again").collect()
    assert Counter((r.text or "", r.again) for r in again) == Counter((t or "", t or "") for t in texts)
    recoded = recode_documents(docs, file).collect()
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) for r in recoded) and len(recoded) == len(texts)
    assert round_trip_digests(docs.limit(0), file).count() == 0 and recode_documents(docs.limit(0), file).count() == 0


def test_orc_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path):
    from pyarrow import fs, orc

    from tidewatch.llm.orc_ids import ids_report, read_ids, write_ids

    file, path = public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/ids"
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('text number ', id) AS text", "'s' AS shard")
    write_ids(docs, f"file://{path}", file, shards=2)
    parts = [f.path for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(path)) if f.path.endswith(".orc")]
    assert len(parts) == 2
    jvm = spark._jvm
    for part in parts:
        f = orc.ORCFile(part)
        assert f.nstripes >= 1 and f.nrows > 2000 and f.row_index_stride == 2000
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        streams = reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()
        kinds = {str(s.getKind()) for s in streams}
        assert "ROW_INDEX" in kinds and kinds & {"BLOOM_FILTER", "BLOOM_FILTER_UTF8"}
    plan = read_ids(spark, f"file://{path}").filter("doc_id = 77")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in plan
    assert read_ids(spark, f"file://{path}").filter("doc_id = 77").count() == 1
    write_ids(docs.limit(0), f"file://{tmp_path}/none", file)
    assert ids_report(spark, f"file://{tmp_path}/none").count() == 0


def test_archives_of_an_empty_table(spark, tmp_path):
    from tidewatch.llm import warc

    pages = spark.createDataFrame([], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    (tmp_path / "w").mkdir()
    warc.write_archives(warc.plan_records(pages), folder).collect()
    assert warc.archive_report(spark, folder).count() == 0


def test_media_columns_of_wav_files(spark):
    from tidewatch.llm import chroma as H

    r = np.random.default_rng(5)

    def wav(samples, channels=1):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(2)
            f.setframerate(H.RATE)
            f.writeframes(np.repeat(np.round(samples * 32000).astype("<i2"), channels).tobytes())
        return out.getvalue()

    songs = [H.tones((r.normal(size=n) / 8).tolist()) for n in (64, 64, 90, 80)]
    media = [(0, wav(songs[0])), (1, wav(songs[0], 2)), (2, wav(songs[1])), (3, wav(songs[2])), (4, wav(songs[3][:100])), (5, None), (6, b""), (7, b"RIFF broken"), (8, wav(songs[0])), (9, wav(songs[2][H.HOP * 4 :]))]
    rows = spark.createDataFrame(media, "media_id long, media binary")
    got = {x.id: x for x in H.recording_report(rows, "media_id", "media", H.wave16, every=3).collect()}
    assert (got[0].class_id, got[1].class_id, got[8].class_id) == (0, 0, 0)
    assert [got[i].n_codes for i in (4, 5, 6, 7)] == [0] * 4 and got[5].class_id is None
    # a copy that begins four hops later aligns at four windows
    assert got[9].best_query == 3 and got[9].best_shift == -4 and got[9].best_errors == 0
    assert H.recording_report(rows.limit(0), "media_id", "media", H.wave16).count() == 0
    whole = H.fingerprint_batch(np.stack([songs[0], songs[1]]))
    assert all(np.array_equal(a, H.fingerprint(b)) for a, b in zip(whole, songs, strict=False))


def test_a_long_word_takes_bounded_memory():
    """Besides the tables, an encoder keeps a few bytes for each byte of a piece."""
    import tracemalloc

    from tidewatch.llm.bpe import codec

    public_tokenizers = pytest.importorskip("public_tokenizers")
    coder = codec(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode("warm up")
    piece = ("abcdefghij" * 30_000).encode()
    tracemalloc.start()
    ids = coder.encode_piece(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"".join(coder.token[i] for i in ids) == piece
    assert peak < 40 * len(piece)


def test_line_dedup_keeps_columns_of_any_name(spark):
    from tidewatch.llm.linededup import remove_lines

    line = "one shared line of boilerplate"
    rows = [(k, f"own words {k}\n{line}", f"s{k}", f"k{k}", k, "t", "g") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __key string, others int, __text string, __gone string")
    out = {r.doc_id: r for r in remove_lines(df).collect()}
    assert [(r["__key"], r.others, r["__text"], r["__gone"]) for _, r in sorted(out.items())] == [(f"k{k}", k, "t", "g") for k in range(12)]
    assert [r.text for _, r in sorted(out.items())] == [rows[0][1], *(f"own words {k}" for k in range(1, 12))]


def test_copies_of_a_text_are_one_trial(spark):
    from tidewatch.llm import quality as Q

    rule = [1] + [0] * (len(Q.RULES) - 1)
    rows = [("copies", True, k % 3, [0] * len(Q.RULES) if k else rule) for k in range(3000)]
    rows += [("texts", True, k, [0] * len(Q.RULES) if k % 400 else rule) for k in range(12000)]
    data = spark.createDataFrame(rows, "stratum string, good boolean, text_key long, levels array<int>")
    floors = {x.stratum: x.floors for x in Q.calibrate(data, 0.02, 0.1).collect()}
    # three texts, however often they occur, show nothing; twelve thousand do
    assert not any(floors["copies"]) and any(floors["texts"])


def test_a_kind_without_a_threshold_is_an_error(monkeypatch):
    from tidewatch.llm import pii as P

    P.model.cache_clear()
    monkeypatch.setattr(P, "examples", lambda kind, seed: [([0.0] * 11, i % 2 == 0) for i in range(200)])
    with pytest.raises(ValueError, match="no threshold"):
        P.model(P.KINDS[4])
    P.model.cache_clear()

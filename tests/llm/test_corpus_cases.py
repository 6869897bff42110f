"""Further cases of the corpus operators: very long texts, odd rows, clashing columns, brute force."""

import datetime
import hashlib
import math
import random
import re

import public_tokenizers
import pytest

from gridloom.llm import bpe, chat, language_id, license_scan, pii, queries, url_filter, warc

CHAT = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 2_000_000 + "x", "word " * 400_000, "a" * 300_000])
def test_chat_encodes_very_long_texts(text):
    c = chat.coder(CHAT)
    assert c.decode(c.encode(text)) == text


def test_chat_masks_are_prefix_sums_over_whole_conversations(spark):
    rows = [(1, t, ("user", "assistant", "system")[t % 3], f"turn {t} </s>" * (t % 5), "x", 1) for t in range(900)]
    rows += [(2, 0, "assistant", " " * 5_000_000, "x", 1), (2, 1, "user", None, "x", 1), (None, None, None, None, "x", 1), (2, 1, "user", None, "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, piece string, token_from int").repartition(7)
    c = chat.coder(CHAT)
    _, end, turn, body = (c.reserved[m] for m in chat.MARKS)
    made = {}
    for r in chat.format_chat(df, CHAT).collect():
        made.setdefault(r.conv_id, []).append(r)
    assert {k: len(v) for k, v in made.items()} == {1: 900, 2: 3, None: 1}
    for conv, got in made.items():
        ids, text, mask = [c.reserved["<s>"]], "<s>", []
        for r in sorted(got, key=lambda r: r.token_from):
            role, said = c.encode(chat.escape(r.role)), c.encode(chat.escape(r.text))
            assert (r.token_from, r.char_from) == (len(ids), len(text))
            assert r.ids == [turn, *role, body, *said, end]
            start = len(ids) + len(role) + 2
            assert (r.loss_from, r.loss_to) == (start, start + (len(said) if r.role == "assistant" else 0))
            ids, text = ids + r.ids, text + r.piece
            mask += [f"{r.loss_from}-{r.loss_to};"] if r.loss_to > r.loss_from else []
            assert (r.token_to, r.char_to) == (len(ids), len(text))
        digest = [d for d in chat.chat_digests(df, CHAT).collect() if d.conv_id == conv][0]
        assert (digest.n_tokens, digest.formatted_chars) == (len(ids), len(text))
        assert digest.mask_sha256 == hashlib.sha256("".join(mask).encode()).hexdigest()


@pytest.mark.parametrize("rows_per_range", [1, 7, 200_000])
def test_warc_histories_match_a_plain_sort(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(warc, "RANGE_ROWS", rows_per_range)
    rnd = random.Random(4)
    odd = ["http://h.com/a\nz", "http://h.com/a!", " http://h.com/a ", "http://h.com/a\t", "\x0bhttp://h.com/\x1f", "http://h.com/\x85", "http://É.com/ü?q=\u2028", "no scheme", "", None, "HTTP://B.a.COM/X", "http://a.com:80/#f", "http://a.com/ \r\n\r\nWARC/1.0"]
    pages = [(i, rnd.choice(odd), f"page {i % 9}" * rnd.choice([1, 300])) for i in range(300)] + [(400, "http://hot/", "x")] * 40 + [(None, None, None)] * 3
    got = warc.warc_round_trip(spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, ts string").repartition(5)).collect()
    assert len(got) == len(pages)
    order = sorted(got, key=lambda r: r.position)
    keys = [(r.url_key.encode(), r.ts, -1 if r.page_id is None else r.page_id) for r in order]
    assert keys == sorted(keys) and [r.position for r in order] == list(range(len(pages)))
    seen = {}
    for r in order:
        assert r.capture == seen.get(r.url_key, 0)
        seen[r.url_key] = r.capture + 1
    plain = lambda u: "".join(f"%{ord(c):02X}" if c in "\t\n\r " else c for c in u or "")
    assert sorted((str(r.page_id), r.url) for r in got) == sorted((str(i), plain(u)) for i, u, _ in pages)


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 256)
    rnd = random.Random(1)
    pages = [(i, f"http://h/{i}", "".join(rnd.choices("abcdef", k=n))) for i, n in enumerate([10] * 700 + [40_000] * 60 + [3_000_000] * 2)]
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    held = {}
    for r in warc.read_warc(spark, str(tmp_path / "w")).collect():
        held.setdefault(r.run, []).append(r.payload_bytes)
    assert sum(map(len, held.values())) == len(pages)
    assert all(sum(v) <= 1 << 20 or len(v) == 1 for v in held.values()) and max(map(len, held.values())) == 256


def naive_bayes_by_hand(learned, texts):
    """Counts, smoothed log-probabilities and posteriors with plain dictionaries."""

    def grams(text):
        out, word = [], " "
        for c in (text or "").lower():
            word += c if c.isalpha() else "" if word.endswith(" ") else " "
        word = word if word.endswith(" ") else word + " "
        return [word[i : i + n] for n in language_id.ORDERS for i in range(len(word) - n + 1)] if word.strip() else out

    bucket = {}

    def place(g):
        if g not in bucket:
            code = 0
            for c in g:
                code = (code << 21) | ord(c)
            x = (code + (len(g) << 60)) % (1 << 64)
            for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                x = (x ^ (x >> shift)) * odd % (1 << 64)
            bucket[g] = x % language_id.BUCKETS
        return bucket[g]

    counts = {}
    for text, lang in learned:
        if text is not None and lang is not None:
            mine = counts.setdefault(lang, {})
            for g in grams(text):
                mine[place(g)] = mine.get(place(g), 0) + 1
    out = []
    for text in texts:
        g = grams(text)
        if not g or not counts:
            out.append(("und", 0.0, 0.0))
            continue
        total = {}
        for lang, c in counts.items():
            n = sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS
            total[lang] = sum(math.log((c.get(place(x), 0) + language_id.SMOOTHING) / n) for x in g)
        best = min(total, key=lambda k: (-total[k], k))
        out.append((best, 1 / sum(math.exp(max(-700, t - total[best])) for t in total.values()), total[best] / len(g) + math.log(language_id.BUCKETS)))
    return out


@pytest.mark.parametrize(("entries", "part"), [(1 << 19, 1 << 18), (50, 7), (1, 1)])
def test_language_scores_do_not_depend_on_parts(monkeypatch, entries, part):
    import numpy as np

    table = np.random.default_rng(1).normal(size=(3, language_id.BUCKETS)).astype(np.float32)
    texts = [None, b"", b"12", "Ab c, d. ééx".encode(), b"..a", b"a..", b"x" * 40, "中文 text 1 2".encode(), b"a b"]
    want, n = language_id.batch_scores(table, texts)
    monkeypatch.setattr(language_id, "ENTRIES", entries)
    monkeypatch.setattr(language_id, "PART", part)
    got, m = language_id.batch_scores(table, texts)
    assert np.allclose(want, got) and n.tolist() == m.tolist() and n[:3].tolist() == [0, 0, 0] and n[4] == 3 + 2 + 1


def test_language_id_matches_naive_bayes_by_hand(spark):
    rnd = random.Random(7)
    parts = {"aa": ["the", "ing", "and", "ou"], "bb": ["ung", "sch", "ein", "ü"], "cc": ["что", "это", "не", "и"]}
    prose = lambda lang, n: " ".join("".join(rnd.choices(parts[lang], k=rnd.randrange(1, 4))) for _ in range(n)) + rnd.choice([".", "!", ""])
    rows = [(i, prose(lang, rnd.randrange(1, 40)), lang) for i, lang in enumerate([*parts] * 20)]
    rows += [(70, None, "aa"), (71, "", "bb"), (72, "12 34", None), (73, prose("aa", 5), None), (None, prose("bb", 9), "cc"), (74, "the" * 20_000, "aa"), (73, "İ ẞ", "aa"), (73, "x", None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, margin int").repartition(3)
    got = language_id.language_id(df).collect()
    import zlib

    mine = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 0
    want = naive_bayes_by_hand([(t, lang) for i, t, lang in rows if mine(i)], [t for _, t, _ in rows])
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 4), round(r.margin, 3)) for r in got)
    for a, b in zip(got, sorted((str(i), lang, round(s, 4), round(m, 3)) for (i, *_), (lang, s, m) in zip(rows, want, strict=True)), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3 and abs(a[3] - b[3]) < 3e-3


def test_bpe_query_matches_the_library_on_a_table(spark):
    """The registered query over a whole table, and texts that the cut at white space must not change."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(-1, "a\x1cb\x1d \x1f"), (-2, "x\u00a0y\u2003z\x85w"), (-3, "e\u0301 \u0308a <|endoftext|>b<|endoftext|> c"), (-4, "İstanbul ΑΣ'S it's"), (-5, "word " * 300_000), (-6, None), (-7, "\u200bx\u3000y" * 3)]
    got = {r.doc_id: r for r in bpe.bpe_digests(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()}
    for i, text in docs:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), i
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), i


P, Q = pii.Permuter(b"key"), pii.Permuter(b"key", back=True)


def pseudonym(s):
    new, kinds = pii.pseudonymise(s, P)
    assert pii.pseudonymise(new, Q) == (s, kinds)
    return new


def test_pii_links_values_across_layouts():
    digits = lambda s: re.sub(r"\D", "", s)
    phones = {digits(pseudonym(s))[-10:] for s in ("(017) 555-7713", "017-555-7713", "017.555.7713", "+1 017 555 7713", "+49 (017) 555 7713")}
    assert len(phones) == 1 and phones != {"0175557713"}
    mails = [pseudonym(s) for s in ("Ann.Lee7@x.com", "ann.lee7@x.com", "ANN.LEE7@X.COM")]
    assert len({m.lower() for m in mails}) == 1 and mails[0] != mails[1] and mails[0].lower() != "ann.lee7@x.com"
    assert len({pseudonym("ann@x.com").split("@")[0], pseudonym("ann@y.com").split("@")[0]}) == 2
    cards = {digits(pseudonym(s)) for s in ("4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111")}
    assert len(cards) == 1
    seen = set()
    for k in range(0, 3_652_059, 1499):  # days of the years 1 to 9999
        day = datetime.date.fromordinal(k + 1)
        y, m, d = f"{day.year:04d}", f"{day.month:02d}", f"{day.day:02d}"
        new = datetime.date.fromisoformat(pseudonym(f"{y}-{m}-{d}"))
        assert datetime.datetime.strptime(pseudonym(f"{d}.{m}.{y}"), "%d.%m.%Y").date() == new
        assert datetime.datetime.strptime(pseudonym(f"{d}/{m}/{y}"), "%d/%m/%Y").date() == new
        if day.day >= 13:
            assert datetime.datetime.strptime(pseudonym(f"{m}/{d}/{y}"), "%m/%d/%Y").date() == new
        assert (day.day >= 13) == (new.day >= 13) and (1900 <= day.year < 2100) == (1900 <= new.year < 2100)
        seen.add(new)
    assert len(seen) == len(range(0, 3_652_059, 1499))


def test_pii_permutes_all_days_of_two_centuries():
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(73_049)]
    image = {pii._date(P, d.isoformat()) for d in days}
    assert image == {d.isoformat() for d in days}


def test_pii_leaves_no_user_in_clear_and_no_clean_number_changed():
    assert pseudonym("_._%+@x.com") != "_._%+@x.com"
    assert pseudonym("ñandú.é@x.com").split("@")[0] != "ñandú.é" and pseudonym("éèù@x.com") != "éèù@x.com"
    assert pseudonym("中文名字@x.com") != "中文名字@x.com" and len(pseudonym("中文名字@x.com")) == len("中文名字@x.com")
    clean = "at 1700000000123 ms, id 9807915762804490, 4111111111111112, v1.2.3, 999.1.1.1, 2024-02-30, 12/2020, 3.14159 a@b x@y"
    assert pii.pseudonymise(clean, P) == (clean, [])
    new, kinds = pii.pseudonymise("9807915762804490", P, numbers=True)
    assert kinds == ["number"] and new != "9807915762804490" and pii.pseudonymise(new, Q, numbers=True)[0] == "9807915762804490"


def test_pii_reads_very_long_texts_whole(spark):
    card, mail = "4111 1111 1111 1111", "ann@x.com"
    text = "word " * 200_000 + card + "\n" + "9 " * 50_000 + "\n" + "x" * 500_000 + " " + mail
    rows = [(1, text, "a", "b"), (2, None, "a", "b"), (2, "", "a", "b"), (1, text, "a", "b")]
    got = sorted((r.doc_id, r.n_values, r.kinds, r.text or "") for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string, kinds string, n_values string"), "k").collect())
    assert [r[:3] for r in got] == [(1, 2, "card,email")] * 2 + [(2, 0, "")] * 2
    assert got[0] == got[1] and len(got[0][3]) == len(text) and card not in got[0][3] and mail not in got[0][3]


def odd_rows():
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choices(["re", "tion", "an", "th", "es"], k=rnd.randrange(1, 4))) for _ in range(n))
    long = prose(30_000)
    rows = [(i, prose(rnd.randrange(8, 60)), "en") for i in range(60)]
    rows += [(100, None, None), (101, "", "en"), (102, "12 34 !", "en"), (None, None, "en"), (103, long, None), (104, long, "en"), (103, long, None), (None, rows[3][1], "en"), (105, rows[4][1] + " ", "en"), (106, rows[5][1], None)]
    return rows + [(110, "Это текст на русском языке о погоде", None), (111, "这是一个关于天气的中文文本", None), (112, "".join(rnd.choices("bcdfghjklmnpqrvwxz", k=400)), None)], rnd


def test_every_stage_handles_odd_rows(spark):
    import corpus_pipeline

    rows, _ = odd_rows()
    kinds = "doc_id long, text string, lang string, lang_pred string, N_Hit string, _gl_rid string, fp string, n_shingles int"
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(*r, f"p{k}", "h", "r", "f", k) for k, r in enumerate(rows)], kinds).repartition(3)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = spark.createDataFrame(stage(spark, now, sf).collect(), docs.schema)
        if stage is corpus_pipeline.identify_language:
            kept = {(r.doc_id, r.text) for r in now.collect()}
            assert {i for i, _ in kept} == {i for i, t, _ in rows} - {100, 101, 102, 110, 111, 112}
            assert now.filter("lang IS NULL").count() == 0 and now.count() == len(rows) - 7
    assert sorted(now.columns) == sorted(docs.columns)
    best = {}
    for i, t, _ in rows:
        if (i, t) in kept:
            n = re.sub(r"[\x20\x09-\x0D]", "", t)
            best[n] = min(best.get(n, (1, True, 0)), (-len(t), i is None, i or 0))
    assert sorted((b[2] for b in best.values())) == sorted(r.doc_id or 0 for r in now.collect())
    last = corpus_pipeline.encode(spark, now, sf).collect()
    assert len(last) == len(best) and all(r.n_tokens > 0 for r in last)


def test_stages_pass_empty_tables(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
        assert name == "bpe" or out.columns == docs.columns


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_language_stage_keeps_all_clean_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


def licence_texts():
    """Whole passages, and passages that vary: a word changed, put in, left out, broken off, in other texts, with a broken key phrase."""
    rnd = random.Random(9)
    out = [None, "", "...", "software license", "the " * 300, "permission " * 50, "cc by cc-by-sa CC BY NC", "K license cc by"]
    for _, passage, key in license_scan.TEMPLATES:
        w = passage.split(" ")
        at = license_scan.key_places(w, key.split(" "))
        free = [i for i in range(len(w)) if i not in at] or [0]
        out += [passage, passage.upper(), "x " * 40 + ", ".join(w) + " y" * 7, " ".join(w[:3]), " ".join(w[2:]), " ".join(w[len(w) // 2 :] + w[: len(w) // 2])]
        for _ in range(2):
            i = rnd.choice(free)
            out += [" ".join([*w[:i], "other", *w[i + 1 :]]), " ".join([*w[:i], "more", *w[i:]]), " ".join([*w[:i], *w[i + 1 :]])]
        out.append(" ".join([*w[: at[0]], "broken", *w[at[0] + 1 :]]))
    out += [" ".join(rnd.choices(" ".join(p for _, p, _ in license_scan.TEMPLATES).split(" "), k=300)) for _ in range(15)]
    return out + ["filler words here " * 1000 + license_scan.TEMPLATES[0][1] + " all rights reserved"]


def test_license_scan_matches_sql_on_varied_passages(spark):
    import duckdb
    import pyarrow as pa

    rows = [(i % 200, t) for i, t in enumerate(licence_texts())] + [(None, license_scan.TEMPLATES[1][1])]
    got = license_scan.scan_licenses(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, words string, n_base int").repartition(3))
    cols = sorted(got.columns)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES['op10_license_scan']})").fetchall()
    have = got.select(*cols).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in have)


def test_license_scan_labels_varied_passages_by_their_key_phrase(spark):
    label, passage, key = license_scan.TEMPLATES[0]
    w = passage.split(" ")
    texts = [passage, passage.replace("merge", "join"), passage.replace("granted free", "given free"), key, "free of charge software copy", passage + " " + license_scan.TEMPLATES[2][1]]
    filler = [f"plain text number {i} of the software and the copy" for i in range(60)]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts + filler)), "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].labels for i in range(6)] == ["mit", "mit", "", "", "", "bsd,mit"] and by[0].score == 1 and 0.9 < by[1].score < 1
    assert all(r.labels == "" for r in got if r.doc_id > 5) and len(w) > 40


def test_license_scan_reads_very_long_texts_whole(spark):
    text = "filler words here " * 100_000 + license_scan.TEMPLATES[0][1] + " all rights reserved"
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).filter("doc_id = 1").first()
    assert (r.n_words, r.n_base, r.labels, r.first_word) == (len(text.split()), 1, "mit,reserved", len(text.split()) - 3)


def test_url_model_on_words_it_has_not_seen(spark):
    """Held-out figures, by words that the labelled table does not hold; and scores worked out by hand from the weights."""
    from pyspark.sql import functions as F

    trained = url_filter.labelled_urls(spark)
    weights = url_filter.fit(trained)
    kept = url_filter.labelled_urls(spark, held_out=True).withColumn("f", url_filter.feature_buckets(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))))
    rows = kept.withColumn("p", url_filter.probability(F.col("f"), weights)).collect()
    assert {r.url for r in rows}.isdisjoint(r.url for r in trained.collect())
    for r in rows:
        z = weights[-1] + sum(weights[i] for i in r.f) / math.sqrt(len(r.f))
        assert abs(r.p - 1 / (1 + math.exp(-z))) < 1e-6
    hit = sum(r.label == 1 for r in rows if r.p >= 0.5)
    assert hit / sum(r.p >= 0.5 for r in rows) > 0.75 and hit / sum(r.label == 1 for r in rows) > 0.2


def test_url_features_are_the_ngrams_of_host_and_path(spark):
    from pyspark.sql import functions as F

    urls = ["http://a.b/c", "http://", "x", None, "http://h" + "o" * 300_000 + "/p?q", "http://é/ü"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    for r in df.withColumn("f", url_filter.feature_buckets(F.col("h"), F.col("p"))).collect():
        grams = {(where, t[i : i + n]) for where, t in (("host", f"^{r.h}$"), ("path", f"^{r.p}$")) for n in url_filter.SIZES for i in range(len(t) - n + 1)}
        if len(grams) < 100:
            want = {x[0] for x in spark.createDataFrame([*grams], "w string, g string").select(F.pmod(F.xxhash64("w", "g"), F.lit(url_filter.BUCKETS)).cast("int")).collect()} if grams else set()
            assert {*r.f} == want
        assert len(r.f) == len({*r.f})

"""The corpus operators against brute force, libraries and round trips, on small fixtures with odd rows."""

import datetime
import hashlib
import random
import re
import zlib
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, decontamination, exact_dedup, language_id, license_scan, ngram_join, pii, queries, url_filter, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def odd_documents():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["été", "naïve", "中文", "Straße"]

    def prose(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    base = prose(120)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one  two"), (6, "...!!!"), (7, base), (8, base), (9, base.replace(" ", "\n")), (10, prose(9000)), (11, base)]
    rows += [(11, base)]  # a repeated row
    rows += [(None, prose(30)), (None, None), (12, "É" * 5000), (13, "a b c d e f g h i j k l")]
    for i in range(60):  # one large group of near copies
        w = base.split(" ")
        w[rnd.randrange(len(w))] = f"x{i}"
        rows.append((100 + i, " ".join(w)))
    for i in range(20):  # and loose ones
        w = base.split(" ")
        for _ in range(rnd.randrange(2, 9)):
            w[rnd.randrange(len(w))] = f"y{rnd.random()}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(rnd.randrange(1, 80))) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1.5, "z") for i, t in odd_documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, score double, n_words string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), str(least.get(root(k))), links[k], len(sets[k])) for k, (i, _) in enumerate(rows))


def test_near_duplicates_match_brute_force(odd):
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_shingles) for r in ngram_join.near_duplicates(odd).collect())
    assert got == near_by_hand(odd_documents())


@pytest.mark.parametrize(("large", "block", "shingles_held"), [(10_000, 512, 1 << 22), (4, 7, 1 << 22), (2, 512, 300)])
def test_near_duplicates_agree_for_any_blocks(odd, monkeypatch, large, block, shingles_held):
    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles_held)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_shingles) for r in ngram_join.near_duplicates(odd).collect())
    assert got == near_by_hand(odd_documents())


def test_near_duplicates_match_brute_force_on_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_shingles) for r in ngram_join.near_duplicates(docs).collect())
    assert got == near_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_near_deduplicated_keeps_one_of_each_class(odd):
    kept = ngram_join.near_deduplicated(odd)
    assert kept.columns == odd.columns
    want = {(i, c) for i, c, _, n in near_by_hand(odd_documents()) if i == c or n == "0"}
    got = [str(r.doc_id) for r in kept.collect()]
    assert sorted({i for i, _ in want}) == sorted({*got})
    assert got.count("7") == 1 and got.count("8") == 0


def test_least_matches_is_monotone():
    least = list(ngram_join.least_matches().values())
    assert least == sorted(least) and 0 < least[-1] < 0.8 * ngram_join.HASHES


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.label) for r in ngram_join.components(edges).collect()} == {(i, 0) for i in range(n + 1)}


def exact_by_hand(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        out += [(str(None if m[1] else m[2]), str(keep), len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out), len(groups)


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup_matches_brute_force(odd, block):
    rows = exact_dedup.exact_dedup(odd, block=block).collect()
    want, groups = exact_by_hand(odd_documents())
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == groups
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_dedup_with_keys_that_clash(odd):
    rows = exact_dedup.exact_dedup(odd, block=11, keys=lambda b: [F.length(b) % 2]).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == exact_by_hand(odd_documents())[0]


def test_deduplicated_keeps_rows_whole(odd):
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == exact_by_hand(odd_documents())[1]


def test_suffix_array_and_fm_index_match_brute_force():
    import numpy as np

    rnd = random.Random(3)
    for n in (1, 2, 9, 60, 400):
        s = np.array([rnd.randrange(2, 5) for _ in range(n)], np.int64)
        s[rnd.randrange(n)] = 1
        full = [*s.tolist(), 0]
        assert decontamination.suffix_array(np.array(full)).tolist() == sorted(range(n + 1), key=lambda i: full[i:])
        index = decontamination.FMIndex(s, 5)
        pats = [[rnd.randrange(2, 5) for _ in range(rnd.randrange(1, 5))] for _ in range(40)]
        rows = np.zeros((40, 5), np.int64)
        for k, p in enumerate(pats):
            rows[k, : len(p)] = p
        lo, hi = index.search(rows, np.array([len(p) for p in pats]))
        for p, a, b in zip(pats, lo, hi, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n) if s[i : i + len(p)].tolist() == p]


def hits_by_hand(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for win in {tuple(v[i : i + 10]) for i in range(max(1, len(v) - 9))} if v and item is not None else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= {*range(i, i + len(win))}
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("blocks", [2, 100_000])
def test_decontamination_matches_brute_force(spark, odd, blocks):
    rows = odd_documents()
    base = rows[6][1].split(" ")
    items = [(10, " ".join(base[5:30])), (2, " ".join(base[20:33])), (7, "a B, c"), (9, None), (8, "..."), (None, "a b"), (11, "no such words here at all"), (12, "w1"), (12, "w1"), (13, "w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(odd, bench, shard_words=700, block_windows=blocks).collect()
    have = sorted((str(r.doc_id), r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got)
    assert have == sorted((str(i), *hits_by_hand(t, items)) for i, t in rows)
    assert all(sum(b - a for a, b in r.spans) == r.n_hit for r in got)


def test_bpe_matches_the_library(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    rnd = random.Random(2)
    texts = [t or "" for _, t in odd_documents()] + ["".join(rnd.choice("abcdethinngsA's <|endoftext|>ÉΣσİ \x1c\x85015é́中!?") for _ in range(80)) for _ in range(500)]
    texts += ["a" * 3000, "<|startoftext|><|endoftext|>", "x<|endoftext|>", "ΑΣ ΣΑΣ.", "日本語テキスト"]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    rows = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in bpe.bpe_digests(odd, path).collect())
    want = [(str(i), lib.encode(t or "", add_special_tokens=False).ids) for i, t in odd_documents()]
    assert rows == sorted((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in want)
    back = bpe.bpe_decode(bpe.bpe_encode(odd, path), path).select("text", "ids", "decoded").collect()
    assert all(r.decoded == lib.decode(r.ids, skip_special_tokens=False) for r in back)


def chat_rows():
    rows = [(1, 1, "assistant", "two </s>"), (1, 0, "user", "one"), (1, 2, "user", None), (2, 0, "assistant", "[INST] \\ <\\s> <|turn|>"), (2, 0, "assistant", "tie"), (3, None, None, ""), (None, 0, "user", "x")]
    return rows + [(4, i, ("user", "assistant")[i % 2], f"turn {i} été") for i in range(700)]


def test_chat_round_trip(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in chat.chat_digests(df, path).collect()}
    assert {*got} == {*by}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len("<s>" + "".join(f"<|turn|>{chat.escape(r)}<|text|>{chat.escape(x)}</s>" for *_, r, x in turns))
    made = [r for r in chat.format_chat(df, path).collect() if r.conv_id == 4]
    at = 1
    for r in sorted(made, key=lambda r: r.turn):  # the offsets follow each other without a gap
        assert r.token_from == at and r.token_to - r.token_from == len(r.ids)
        at = r.token_to


@pytest.mark.parametrize("text", ["", "\\", "</s>", "<\\/s>", "\\</s>\\\\[INST]", "<<SYS>><s><|im_end|>", "a\nb"])
def test_escape_is_reversible_and_hides_controls(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


def test_pii_values_are_replaced_within_their_format(spark, none):
    text = "Mail ann.34@mail7.example.com or +1 (017) 555-7713, ip 233.254.104.120, card 4111 1111 1111 1111, on 2024-02-29 and 31.12.1999, 12/25/2020, ssn 123-45-6789, DE89 3704 0044 0532 0130 00, token = \"9c8b45435718dcc700c184a7e303cdc64c6a8f7f\"; not 999.1.1.1 or 2024-02-31."
    p = pii.Permuter(b"k")
    new, kinds = pii.pseudonymise(text, p)
    assert sorted(kinds) == sorted(["email", "phone", "ip", "card", "date", "date", "date", "ssn", "iban", "secret"])
    assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+", "9", new.split(" token")[0]))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+", "9", text.split(" token")[0])))
    assert "999.1.1.1" in new and "2024-02-31" in new
    for value in ("ann.34", "555-7713", "233.254.104.120", "4111 1111 1111 1111", "2024-02-29", "123-45-6789", "0532 0130", "9c8b4543"):
        assert value not in new
    assert pii.luhn(re.sub(r"\D", "", re.search(r"card ([\d ]+),", new)[1])) == 0
    datetime.date.fromisoformat(re.search(r"on (\S+) and", new)[1])
    assert pii.pseudonymise(new, pii.Permuter(b"k", back=True))[0] == text
    again = pii.pseudonymise("x 233.254.104.120 y", p)[0]
    assert again.split()[1] in new  # equal values stay linked
    df = spark.createDataFrame([(1, text, "q"), (2, None, "q"), (3, "", "q"), (1, text, "q")], "doc_id long, text string, kinds string")
    got = sorted((r.doc_id, r.text, r.n_values) for r in pii.pii(df, "k").collect() if r.text)
    assert got[0] == got[1] and got[0][2] == 10
    assert pii.pii(none, "k").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 366, 1000])
def test_feistel_is_a_permutation(n):
    p, q = pii.Permuter(b"key"), pii.Permuter(b"key", back=True)
    image = [p.number(b"x", i, n) for i in range(n)]
    assert sorted(image) == list(range(n)) and [q.number(b"x", i, n) for i in image] == list(range(n))


def test_us_dates_are_permuted_among_themselves():
    p, q = pii.Permuter(b"key"), pii.Permuter(b"key", back=True)
    seen = set()
    for m in range(1, 13):
        for d in range(13, 32):
            try:
                datetime.date(2021, m, d)
            except ValueError:
                continue
            s = f"{m:02d}/{d:02d}/2021"
            new = pii.pseudonymise(s, p)[0]
            seen.add(new)
            assert pii.pseudonymise(new, q)[0] == s
    assert len(seen) == sum(1 for m in range(1, 13) for d in range(13, 32) if not (m == 2 and d > 28) and not (d == 31 and m in (4, 6, 9, 11)))


def test_url_verdicts(spark):
    urls = ["http://a.COM/en/1", "http://x.example.com/en/7a?x", "https://net/de/", "http://example.net/de/8", "http://b.example.net/de/9#f", "ftp://q.org/es/", "http://notorg/es/", None, "no scheme", "http://casino-poker.com/slots/jackpot", "http://h?x/y", "http://H#/y", "x\n://Host/p\nq?z", "http://docs.org/library/en"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[0], "clash"), (0, urls[0], "clash")]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    want = [("a.com", "/en/1", "com/en/"), ("x.example.com", "/en/7a", "example.com/en/7"), ("net", "/de/", "net/de/"), ("example.net", "/de/8", "example.net/de/8"), ("b.example.net", "/de/9", "net/de/"), ("q.org", "/es/", "org/es/"), ("notorg", "/es/", None), ("", "", None), ("", "", None), ("casino-poker.com", "/slots/jackpot", None), ("h", "", None), ("h", "", None), ("host", "/p\nq", None), ("docs.org", "/library/en", None)]
    for i, (host, path, rule) in enumerate(want):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert rule is None or got[i].verdict == dict(url_filter.RULES)[rule]
        assert 0 <= got[i].score <= 1
    assert got[9].verdict == "block" and got[13].verdict == "allow"


def test_warc_round_trip(spark):
    big = "<p>é" * 400
    rows = [(1, "http://b.example.com/1", big), (2, None, big), (3, "http://a.example.com/x\r\ny", "x" * 999), (4, "http://a.example.com/", "x" * 999), (5, "http://c/", None), (6, "http://c/", ""), (None, "http://n/", big), (7, "http://d/", "WARC/1.0\r\n\r\nodd\r\n\r\n" * 60), (8, "http://d/", big), (8, "http://d/", big)]
    got = warc.warc_round_trip(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)).collect()
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        same = h == big.encode() and i != 8
        want.append((str(i), len(h), hashlib.sha1(h).hexdigest(), "revisit" if same else "response", "8" if same else "None"))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    order = sorted(got, key=lambda r: r.position)
    keys = [(r.url_key, r.ts) for r in order]
    assert keys == sorted(keys) and [r.position for r in order] == list(range(len(rows)))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(0, 12))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_license_scan_matches_brute_force(spark, odd):
    rnd = random.Random(8)
    extra = ["All rights reserved.", "ALL RIGHTS, reserved all rights reserved", "cc by cc-by-nc CC BY SA", "the GNU General Public License, version 3", "general public licence", "by cc by", "Kelvin: all rights reserved", None, "", "cc" + " by" * 3]
    extra += [" ".join(rnd.choice("cc by all rights reserved general public license x".split()) for _ in range(200)) for _ in range(20)]
    rows = [*odd_documents(), *((1000 + i, t) for i, t in enumerate(extra))]
    got = license_scan.scan_licenses(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int")).collect()

    def by_hand(i, t):
        w = words(t)
        found = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in license_scan.BASE}
        at = sorted(k for p in found for k in found[p])
        return str(i), len(w), len(at), str(at[0] if at else None), str(at[-1] if at else None), ",".join(sorted({x for p, x in license_scan.BASE.items() if found[p]}))

    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted(by_hand(i, t) for i, t in rows)
    assert all({*r.base_labels.split(",")} <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 for r in got)


def test_language_id_holds_out_and_is_accurate(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.95
    none_learned = language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none_learned} == {"und"} and len(none_learned) == len(odd_documents())
    some = language_id.language_id(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))).collect()
    assert all((r.lang_pred == "und") == (r.score == 0) for r in some)
    assert {r.lang_pred for r in some if r.doc_id in (1, 2, 3, 6)} == {"und"}


def test_empty_tables(spark, none):
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.near_deduplicated(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.deduplicated(none).count() == 0
    assert language_id.language_id(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert bpe.bpe_digests(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert decontamination.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn int, role string, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect())


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in docs.collect()}
    now, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = spark.createDataFrame(stage(spark, now, sf).collect(), docs.schema)
        assert now.columns == docs.columns
        steps[name] = sorted(r.doc_id for r in now.collect())
    kept = steps["language_id"]
    assert {i for i, t in texts.items() if i not in kept} >= {i for i, t in texts.items() if not any(c.isalpha() for c in t or "")}
    rows = [(i, texts[i]) for i in kept]
    best = {}
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[n] = min(best.get(n, (1, 0)), (-len(t), i))
    assert steps["exact_dedup"] == sorted(i for _, i in best.values())
    near = near_by_hand([(i, texts[i]) for i in steps["exact_dedup"]])
    assert steps["ngram_jaccard_join"] == sorted(int(i) for i, c, *_ in near if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    wins = {" ".join(w) for _, t in items for w in [words(t)[k : k + 10] for k in range(max(1, len(words(t)) - 9))]}
    joined = {i: f" {' '.join(words(texts[i]))} " for i in steps["ngram_jaccard_join"]}
    clean = [i for i in steps["ngram_jaccard_join"] if not any(f" {w} " in joined[i] for w in wins)]
    assert steps["benchmark_decontamination"] == clean
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, lib.encode(texts[i], add_special_tokens=False).ids) for i in clean]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.encode(spark, now, sf).collect())
    assert got == [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in want]


def test_pii_finds_addresses_with_letters_of_any_script():
    new, kinds = pii.pseudonymise("vi êpeña.58@mail7.example.com## la", pii.Permuter(b"k"))
    assert kinds == ["email"] and "58@" not in new and new.endswith("@mail7.example.com## la") and new.startswith("vi ê")


def test_url_model_learns_its_table(spark):
    rows = url_filter.url_verdicts(url_filter.labelled_urls(spark).withColumn("page_id", F.col("label")), rules=[]).collect()
    assert sum((r.verdict == "block") == (r.page_id == 1) for r in rows) / len(rows) > 0.95


def test_pruning_hardly_ever_loses_a_pair_at_the_threshold():
    from math import comb

    least, t, live, lost = ngram_join.least_matches(), 0.8, {0: 1.0}, 0.0
    for n in range(ngram_join.STEP, ngram_join.HASHES + 1, ngram_join.STEP):
        new = {}
        for m, p in live.items():
            for k in range(ngram_join.STEP + 1):
                new[m + k] = new.get(m + k, 0) + p * comb(ngram_join.STEP, k) * t**k * (1 - t) ** (ngram_join.STEP - k)
        lost += sum(p for m, p in new.items() if m < least[n])
        live = {m: p for m, p in new.items() if m >= least[n]}
    assert lost < 1e-8 and min(least.values()) > 0  # every step can prune

"""Mixing, chat formatting, SentencePiece, language, quality, WARC, surrogates and the pipeline on small fixtures."""

from __future__ import annotations

import hashlib
import io
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import TESTDATA
from tests.llm.test_pairs import frame
from tracewright.llm import chat, langid, mixing, pieces, pii, quality, warc


def saved(df, folder, name):
    df.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


# Mixing


def sourced(spark, seed=3):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.choice([1, 5, 40, 300])), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(900)]
    rows += [(2000, None, "a"), (2001, " ", "z"), (2002, "w w", "b"), (2002, "w w", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("copies", F.lit(1)), rows


def brute_targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(size.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            return size, target | share
        for s in full:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        open_ -= full
    return size, target


def test_mix_meets_its_targets(spark):
    docs, rows = sourced(spark)
    got = mixing.mix(docs).collect()
    size, target = brute_targets(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= 300  # one document at most is left to a last draw
    again = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["size"]): r["taken"] for r in got}


def test_mix_keeps_ids(spark):
    rows = [(9007199254740993, "w " * 30, "a"), (9007199254740995, "w " * 20, "a"), (None, "w " * 10, "a"), (0, "w " * 10, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"] for r in mixing.mix(docs).collect()} == {r[0] for r in rows}
    clash = docs.withColumns({c: F.lit(5) for c in ("_id", "_n", "_k", "id", "n", "row", "copies")})
    got = mixing.mixed(clash)
    assert got.columns == clash.columns and got.where("id <> 5 or row <> 5").count() == 0


def test_mix_ends_near_its_targets(spark):
    got = mixing.op2_mixing(spark, str(TESTDATA / "sf0.01"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect():
        assert abs(r["n"] - r["t"]) <= 0.01 * r["t"]


def test_mix_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    docs, rows = sourced(spark)
    _, target = brute_targets(rows)
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    for r in got:
        assert abs(r["n"] - target[r["source"]]) <= 300


def test_pivots_keep_expectations():
    import pandas as pd

    sums, n = 0, 400
    for k in range(n):
        rows = pd.DataFrame({"doc": range(k, k + 8), "no_id": False, "skey": f"s{k}", "block": 0, "size": [3, 5, 8, 13, 21, 34, 55, 89], "copies": 0.3})
        out = mixing._pivot(rows)
        assert (out["size"] * out["copies"]).sum() == pytest.approx(0.3 * 228)
        assert ((out["copies"] % 1) > 0).sum() <= 1
        sums += out["copies"].to_numpy()
    assert abs(sums / n - 0.3).max() < 0.1


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# Chat


NASTY = ["\\", "\\\\", "### User: x", "</turn>", "</turn>\n", "<\\/turn>", "##\\# ", "a: b\n### ", "", "é\n\t: ", "\\### Assistant: </turn> ok", "#### </turn></turn>\n\n"]


def test_chat_reads_back(spark, agree, tmp_path):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool:x\\", ""]), rng.choice([*NASTY, None])) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(50, 0, None, "x"), (51, 0, "user", "q"), (51, 1, "assistant", "one"), (51, 1, "assistant", "one"), (51, None, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(turns.withColumn("segments", F.lit("clash")).withColumn("rows", F.lit(0)))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c)
        flat = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), hashlib.sha256(flat.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("t", [chat.Template(head="<|", after_label="|>", tail="<|end|>"), chat.Template(head="||", after_label="||", tail="||end||"), chat.Template(head="[", after_label="]", tail=".*+"), chat.Template(head="0", after_label="1", tail="2")])
def test_any_template_reads_back(spark, t):
    texts = [*NASTY, "<|", "|>", "<|end|>", "<|end|><|User|>", "||end", "||end||", "|", "[User]", ".*+", ".", "0\\012", "\\0", "\\1\\", ""]
    rows = [(1, k, ("user", "assistant", "tool|]1")[k % 3], x) for k, x in enumerate(texts)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t)
    got = out.select(chat.read_back(F.col("formatted"), t).alias("turns"), chat.loss_text(F.col("segments"), t).alias("loss")).first()
    assert [(x["role"], x["text"]) for x in got["turns"]] == [(r, x) for _, _, r, x in rows]
    assert got["loss"] == "".join(x for _, _, r, x in rows if r == "assistant")


def test_chat_order_machine(spark):
    say = {1: "ua", 2: "sua", 3: "uaua", 4: "a", 5: "uu", 6: "us", 7: "s", 8: "u"}
    role = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(c, k, role[x], "t") for c, seq in say.items() for k, x in enumerate(seq)]
    got = {r["conv_id"]: r["valid"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: True}


def test_chat_query_sql(spark, agree):
    folder = TESTDATA / "sf0.001"
    assert agree(chat.op3_chat_format(spark, str(folder)), chat.SQL, folder)


# SentencePiece


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_are_the_librarys(spark):
    m = library()
    rng = random.Random(8)
    texts = ["", " ", "   two  spaces ", "Hello world, 123!", "naïve Ünïcode ²³ words", "line\none\ttab", "漢字かな 😀", "x" * 200, "ab" * 3000, "a_b", "▁", "nul\0\0\1l", "z" * 59, "y" * 60, "tion" * 31, "a" + " " * 15 + "b", "c" + " " * 31, " " * 100, "e \t" + " " * 18 + "1"]
    texts += [" ".join("".join(rng.choice("abcdefgh ijklmnopé1") for _ in range(rng.randrange(1, 9))) for _ in range(12)) for _ in range(15)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(50, 400))) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(500, None), (1, " "), (None, "no id")]
    got = pieces.encoded(frame(spark, rows), block_bytes=100).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        text = by[r["doc_id"]] or ""
        ids = m.encode(text)
        if "▁" not in text and "\0" not in text:  # the library reads its own sign as a space, and drops what stands for nothing
            assert list(r["ids"]) == ids, text
        assert r["n_pieces"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r["ids"])).hexdigest()
        assert pieces.decode(list(r["ids"]), pieces.load()) == text
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest(), text


def test_pieces_of_whole_documents_are_the_librarys(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.01" / "documents.parquet")).select("doc_id", "text")
    m = library()
    want = {r["doc_id"]: m.encode(r["text"] or "") for r in docs.collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.encoded(docs, block_bytes=1 << 18).collect()}
    assert [d for d in want if want[d] != got[d]] == []


def test_no_piece_is_made_of_a_later_one():
    """The fold in order of ranks is exact for this model: each piece's own merges come before it."""
    ranks = pieces.load().ranks
    for piece, i in ranks.items():
        parts, last = list(piece), -1
        while len(parts) > 1:
            rank, k = min((ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            assert last <= rank <= i
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            last = rank


def test_viterbi_of_a_unigram_model(spark):
    rng = random.Random(5)
    made = {c: -6.0 - k / 7 for k, c in enumerate(" abc")} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))): -rng.random() * 9 for _ in range(40)}
    ids = {p: 300 + k for k, p in enumerate(made)}
    m = pieces.Pieces(ids, made, 3, [b""] * 400, "", False)
    units = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30))) for _ in range(60)}
    got = {r["unit"]: list(r["ids"]) for r in pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), m).collect()}

    def best(u):
        top = [(0.0, [])]
        for e in range(1, len(u) + 1):
            some = [(top[s][0] + made[u[s:e]], [*top[s][1], ids[u[s:e]]]) for s in range(max(0, e - 5), e) if u[s:e] in made]
            some += [] if u[e - 1] in made else [(top[e - 1][0] - 1e12, [*top[e - 1][1], *(3 + b for b in u[e - 1].encode())])]
            top.append(max(some))
        return top[-1][1]

    assert got == {u: best(u) for u in units}


def test_pieces_of_nothing(spark):
    assert pieces.encoded(frame(spark, [])).count() == 0


# Language


def test_language_of_held_out_documents(spark):
    folder = str(TESTDATA / "sf0.01")
    got = langid.op6_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = got.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert row[1] > 100 and row[0] > 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    rows = [(k, t, a) for k in range(0, 40, 2) for t, a in ((f"the cat and the dog {k}", "en"), (f"der hund und die katze {k}", "de"), (f"le chat et le chien {k}", "fr"))]
    docs = spark.createDataFrame([(n, t, a) for n, (_, t, a) in enumerate(rows)], "doc_id long, text string, lang string").withColumn("x", F.lit(1))
    model = langid.fit(docs)
    ask = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "die katze und der hund"), (4, "die katze und der hund"), (5, "le chien et le chat")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(ask, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "fr")]
    assert langid.fit(docs.where("false")) is None
    assert {r["lang_pred"] for r in langid.predict(ask, None).collect()} == {"und"}


# Quality


def test_quality_matches_sql(spark, agree, tmp_path):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "a b c\n" * 40), (5, "SHOUT " * 30 + "quiet words here " * 3), (6, "# $ % " * 40 + "w"), (7, "é ü 漢 " * 60)]
    rows += [(k, "\n".join(" ".join(rng.choice(["red", "Green", "BLUE", "x#", "é"]) + str(rng.randrange(30)) for _ in range(9)) for _ in range(rng.randrange(1, 12)))) for k in range(10, 60)]
    rows += [(100, "- item word\n" * 40), (101, "\u2022 item word\n" * 40), (102, "it trails off...\n" * 5 + "no word of it\n" * 9), (103, "12 34 word " * 30), (104, "a b c d e f g " * 9), (105, "x" * 50 + " yes" * 60)]
    rows += [(106, " ".join(f"long{k}" for k in range(60_000))), (107, "y" * 100_000)]
    rows.append((10, rows[8][1]))
    folder = saved(frame(spark, rows), tmp_path, "documents")
    assert agree(quality.op7_quality_rules(spark, folder), quality.SQL, folder) == len(rows)


def test_quality_order_does_not_change_verdicts(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.001" / "documents.parquet"))
    a = {tuple(r) for r in quality.keep_good(docs, quality.RULES).select("doc_id").collect()}
    b = {tuple(r) for r in quality.keep_good(docs, quality.RULES[::-1]).select("doc_id").collect()}
    assert a == b and len(a) > 50
    worth = quality.estimate(docs)
    assert {w[0] for w in worth} == {r.name for r in quality.RULES} and all(0 <= w[2] <= 1 for w in worth)
    assert quality.keep_good(docs.where("false")).count() == 0


# WARC


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, agree, tmp_path, compress):
    long = "<html>" + "x" * 120
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u\r\nv", "é" * 80 + "\r\n\r\nWARC/1.1\r\n"), (7, "u", "\x1f\x8b\x08" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = saved(pages, tmp_path, "pages")
    got = warc.round_trip(pages, compress)
    assert got.where("gap").count() == 0
    agree(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), warc.SQL, folder)


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_quarantines_only_the_damage(compress):
    def made(k):
        body = bytes(random.Random(k).randrange(32, 127) for _ in range(500))
        r = warc.record(k, f"http://{k}", body, hashlib.sha256(body).hexdigest(), None)
        return warc._member(r) if compress else r

    parts = [made(k) for k in range(6)]
    broken = list(parts)
    broken[1] = parts[1][:200] + b"\0\0\0\0" + parts[1][204:]
    broken[3] = parts[3][:150]  # cut off
    data = b"".join(broken) + b"junk at the end"
    found = list(warc.salvage(pa.PythonFile(io.BytesIO(data), "r")))
    assert [x["page_id"] for x in found if not x["gap"]] == [0, 2, 4, 5]
    gaps = [(x["start"], x["end"]) for x in found if x["gap"]]
    at = [sum(map(len, broken[:k])) for k in range(7)]
    assert gaps == [(at[1], at[2]), (at[3], at[4]), (at[6], len(data))]


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Surrogates

PEOPLE = [
    (1, "Mail anna.b@corp.com or Anna.B@Corp.com, call +49 30 1234 5678."),
    (2, "Mr. John Smith met Mrs Mary Jones; MR is no title. Card 4111 1111 1111 1111, ip 10.20.30.40"),
    (3, "Mr. John Smith again, anna.b@corp.com again, card 4111111111111111 and iban DE89 3704 0044 0532 0130 00"),
    (4, None),
    (5, ""),
    (6, "nothing private here, version 1.2 of 2024"),
    (7, "Господин Иван Петров и Госпожа Анна Петрова"),
    (3, "Mr. John Smith again, anna.b@corp.com again, card 4111111111111111 and iban DE89 3704 0044 0532 0130 00"),
]


def test_surrogates_are_consistent(spark):
    got = {}
    for r in pii.replaced(frame(spark, PEOPLE), count="n_entities").select("doc_id", "text", "n_entities").collect():
        assert got.setdefault(r["doc_id"], r) == r
    assert (got[4]["text"], got[5]["text"], got[6]["text"]) == (None, "", PEOPLE[5][1])
    for d in (1, 2, 3, 7):
        for secret in ("anna.b", "Smith", "1234 5678", "4111", "10.20.30.40", "DE89 3704", "Петров"):
            assert secret not in got[d]["text"]
    mails = re.findall(r"\S+@\S+\w", got[1]["text"])
    assert mails[0].lower() == mails[1].lower() and mails[0].lower() in got[3]["text"].lower()
    name = re.search(r"Mr\. (\w+ \w+) met Mrs (\w+ \w+)", got[2]["text"])
    assert f"Mr. {name[1]} again" in got[3]["text"] and name[1] != name[2]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[2]["text"])[0].replace(" ", "")
    assert card in got[3]["text"]
    digits = [int(x) for x in card[::-1]]
    assert sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"Господин [А-Яа-яЁё]+ [А-Яа-яЁё]+ и Госпожа [А-Яа-яЁё]+ [А-Яа-яЁё]+", got[7]["text"])


def test_surrogates_stay_distinct(spark):
    rows = [(k, f"ip 10.0.{k // 250}.{k % 250}, ssn 123-45-{k:04d}, mail u{k}@x.org") for k in range(1500)]
    texts = spark.createDataFrame([(str(k), t) for k, t in rows], "thash string, text string")
    texts = texts.withColumn("found", pii.found_in(F.col("text"))).withColumn("pattern", pii.own_pattern(F.col("found")))
    spots = pii.mentions(texts)
    names = pii.assign(pii.entities(spots), "key")
    assert names.count() == 4500 == names.select("kind", "surrogate").distinct().count()
    real = spots.select("kind", F.col("value").alias("surrogate"))
    assert names.join(real, ["kind", "surrogate"]).count() == 0


def surrogates_of(spark, texts, key="key"):
    rows = pii.replaced(frame(spark, list(enumerate(texts))), key).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_one_person_one_surrogate(spark):
    got = surrogates_of(spark, ["Mr John Smith met John Smith. Mr Smith wrote. Dr Jane Roe came. Smith left, JOHN SMITH too.", "Dr Jane Roe and Ms Jane Roe, Prof. Lee"])
    m = re.fullmatch(r"Mr (\w+) (\w+) met (\w+) (\w+)\. Mr (\w+) wrote\. Dr (\w+) (\w+) came\. (\w+) left, JOHN SMITH too\.", got[0])
    assert m, got
    assert m[1] == m[3] in pii._FIRST["m"] and m[2] == m[4] == m[5] == m[8]
    again = re.fullmatch(r"Dr (\w+) (\w+) and Ms (\w+) (\w+), Prof\. (\w+)", got[1])
    assert (again[1], again[2]) == (again[3], again[4]) == (m[6], m[7]) and m[6] in pii._FIRST["f"]
    assert not {"Smith", "Jane", "Roe", "Lee"} & set(re.findall(r"\w+", " ".join(got)))


def test_formats_stay_valid(spark):
    got = surrogates_of(spark, ["+49 30 1234 5678, +44 (20) 7946 0958, +1 212 555 0100, (212) 555-0123", "IBAN DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819", "123-45-6789"])
    assert re.fullmatch(r"\+49 \d\d \d{4} \d{4}, \+44 \(\d\d\) \d{4} \d{4}, \+1 \d{3} \d{3} \d{4}, \(2\d\d\) \d{3}-\d{4}", got[0]), got[0]
    m = re.fullmatch(r"IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (GB\d\d[A-Z]{4}\d{14})", got[1])
    for iban in m.groups():
        iban = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"[1-5]\d\d-\d[1-9]-\d{3}[1-9]", got[2])


def test_keys_and_reruns(spark):
    text = ["Mrs Ann Lee, a@b.org"]
    assert surrogates_of(spark, text, "one") == surrogates_of(spark, text, "one") != surrogates_of(spark, text, "two")
    spark.conf.set(pii.KEY_SETTING, "one")
    assert surrogates_of(spark, text, None) == surrogates_of(spark, text, "one")
    spark.conf.unset(pii.KEY_SETTING)


def test_a_full_space_widens(spark):
    """The 100 phones of one short form are all taken, so their surrogates need more digits."""
    real = spark.createDataFrame([("phone", f"1{k:02d}", "n") for k in range(100)], "kind string, value string, gender string")
    got = [r["surrogate"] for r in pii.assign(real, "key").collect()]
    assert len(set(got)) == 100 and all(len(x) > 3 for x in got)


def test_surrogates_against_brute_force(spark):
    """Every mention and nothing else is replaced: texts between mentions, and counts, by a regular expression outside Spark."""
    import regex

    docs = spark.read.parquet(str(TESTDATA / "sf0.01" / "documents.parquet")).select("doc_id", "text")
    titled = regex.compile(pii._TITLED)
    got = {r["doc_id"]: r for r in pii.replaced(docs, "key", count="n").collect()}
    for r in docs.collect():
        text = r["text"] or ""
        names = {titled.sub("", m[0]) for m in regex.finditer(pii.PATTERN, text) if titled.match(m[0])}
        names |= {p.rpartition(" ")[2] for p in names if " " in p and len(p.rpartition(" ")[2]) > 2}
        pattern = pii.PATTERN + (rf"|(?<!\w)(?:{'|'.join(sorted(names, reverse=True))})(?!\w)" if names else "")
        parts, at, n = [], 0, 0
        for m in regex.finditer(pattern, text):
            parts.append(regex.escape(text[at : m.start()]))
            at, n = m.end(), n + 1
        assert got[r["doc_id"]]["n"] == n
        assert regex.fullmatch("(.+?)".join([*parts, regex.escape(text[at:])]), got[r["doc_id"]]["text"] or "")


def test_surrogates_keep_columns_of_any_name(spark):
    docs = frame(spark, PEOPLE).withColumns({c: F.lit("x") for c in ("_new", "_thash", "new", "thash", "found", "pattern", "original", "gender", "surrogate")})
    got = pii.replaced(docs, "key")
    assert got.columns == docs.columns and got.where("_thash <> 'x' or new <> 'x' or found <> 'x'").count() == 0 and got.count() == len(PEOPLE)


def test_surrogates_in_a_very_long_text(spark):
    text = "word " * 40_000 + "mail me@x.org " + "word " * 40_000
    (got,) = surrogates_of(spark, [text])
    assert "me@x.org" not in got and got.count("word ") == 80_000


def test_surrogates_of_nothing(spark):
    assert pii.replaced(frame(spark, [])).count() == 0


# Pipeline


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(str(TESTDATA / "sf0.001" / "documents.parquet"))
    folder = saved(docs, tmp_path, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "surrogates", "mix_sources", "sentencepiece"]
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / f"s{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"s{k}")))
    ids = [sorted(r[0] for r in d.select("doc_id").collect()) for d in seen]
    want = {r["doc_id"] for r in quality.measure(docs).where("kept").select("doc_id").collect()}
    assert set(ids[1]) == want
    assert set(ids[2]) < set(ids[1]) and ids[3] == ids[2]
    assert set(ids[4]) <= set(ids[3]) and len(ids[5]) == len(ids[4])
    assert seen[3].where("n_chars <> char_length(text)").count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty, very long and repeated texts, ties and clashing names; stages against brute force where they decide."""
    from tests.llm.test_pairs import brute_links, sentences

    rng = random.Random(11)
    base = [sentences(rng, 120, 4000) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)] + [(20 + k, t + " one more") for k, t in enumerate(base[:6])] + [(40, base[0]), (40, base[0]), (41, None), (42, ""), (43, " \n"), (44, sentences(rng, 30_000, 4000)), (None, base[1])]
    rows += [(50, base[2].replace(" ", " Mr John Smith said to me@x.org ", 1)), (51, "a a a " * 60)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for (i, t), s in zip(rows, ["s0", "s0", None, "s1"] * 20, strict=False)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(7) for c in ("_id", "_n", "row", "new", "thash", "found", "copies", "cid", "raw", "kept", "n", "id")})
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, "")
    kept = {r["doc_id"] for r in quality.measure(docs).where("kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == kept and not kept & {41, 42, 43, 51} and good.where("doc_id = 40").count() == 2
    one = stage["near_duplicates"](spark, docs, "")
    want = sorted(str(d) for d, _, c in brute_links([(d if d is not None else 10**9, t) for d, t in rows], 5, 80) if d == c or d == 10**9)
    assert one.columns == docs.columns and sorted(str(r["doc_id"] if r["doc_id"] is not None else 10**9) for r in one.collect()) == want
    clean = stage["surrogates"](spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where("text like '%Smith%' or text like '%me@x.org%' or n_chars <> char_length(text)").count() == 0
    mixed = stage["mix_sources"](spark, docs, "")
    assert mixed.columns == docs.columns and mixed.where("row <> 7").count() == 0
    assert {str(r["doc_id"]) for r in mixed.collect()} <= {str(d) for d, _ in rows}
    out = stage["sentencepiece"](spark, docs, "").collect()
    m = library()
    assert sorted((str(r["doc_id"]), r["n_pieces"]) for r in out) == sorted((str(d), len(m.encode(t or ""))) for d, t in rows)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(str(TESTDATA / "sf0.001" / "documents.parquet")).where("false")
    assert corpus_pipeline.run(spark, saved(docs, tmp_path, "documents")).count() == 0

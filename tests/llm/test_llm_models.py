import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

from cleanlake.llm import langid, lattice, secret_forest, surrogates


def segmentations(vocab, text):
    lat, out = lattice.Lattice(vocab, [text]), {}

    def go(node, ids, lp):
        if node == lat.end[0]:
            out[tuple(ids)] = lp
            return
        for e in range(lat.first[node], lat.first[node + 1]):
            go(lat.dst[e], [*ids, int(lat.pid[e])], lp + lat.log_q[e])
    go(0, [], 0.0)
    return out


def test_lattice_sums_to_one_and_samples_follow_it():
    vocab = lattice.pieces(lattice.MODEL)
    want = segmentations(vocab, b" there")
    assert abs(sum(map(math.exp, want.values())) - 1) < 1e-9
    for ids in want:
        assert lattice.decode_ids(vocab, np.array(ids)) == b" there"
    n = 4000
    out = lattice.sample(vocab, [b" there"] * n, np.arange(n).astype(np.uint64), 3)
    first = collections.Counter(tuple(o[0][0].tolist()) for o in out)
    weight = collections.Counter()
    for o in out:
        assert len({tuple(x[0].tolist()) for x in o}) == 3
        for ids, lp, inc in o:
            assert abs(lp - want[tuple(ids.tolist())]) < 1e-9 and inc <= 0
            weight[tuple(ids.tolist())] += 1 / math.exp(inc)
    for ids, lp in sorted(want.items(), key=lambda x: -x[1])[:4]:
        p = math.exp(lp)
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n)
        assert abs(weight[ids] / n - 1) < 0.25          # inclusion chances weigh the samples without bias


def test_lattice_draws_all_of_a_small_one_in_order():
    vocab = lattice.pieces(lattice.MODEL)
    want = segmentations(vocab, b"ab c")
    (out,) = lattice.sample(vocab, [b"ab c"], np.array([5], np.uint64), 50)
    assert {tuple(x[0].tolist()) for x in out} == set(want) and all(x[2] == 0 for x in out)


def test_lattice_rows(odd_docs, empty_docs):
    got = lattice.encode(odd_docs, k=3)
    back = lattice.decode(got).collect()
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    assert {(r.row_key, r.text) for r in back} == set(texts)
    again = {(r.row_key, r.sample, tuple(r.ids)) for r in lattice.encode(odd_docs.repartition(7), k=3).collect()}
    assert again == {(r.row_key, r.sample, tuple(r.ids)) for r in back}
    assert all(len({tuple(x.ids) for x in back if (x.row_key, x.text) == k}) == len([x for x in back if (x.row_key, x.text) == k]) / n for k, n in texts.items())
    assert lattice.encode(empty_docs).count() == 0
    assert all(r.round_trip for r in lattice.report(odd_docs).collect())


def test_language_of_documents(spark, sf, odd_docs, empty_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hidden = docs.withColumn("said", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.col("lang")))
    got = langid.identify(langid.document_evidence(hidden, lang_col="said")).join(docs.select(F.col("doc_id").alias("id"), "lang", "text").withColumnRenamed("lang", "truth"), "id")
    rows = got.collect()
    held_out = [r for r in rows if r.declared is None]
    assert len(held_out) > 20 and sum(r.lang == r.truth for r in held_out) / len(held_out) > 0.95
    assert all(r.kept for r in rows if r.text and r.text.strip())
    foreign = docs.limit(0).unionByName(docs.where("doc_id < 60")).unionByName(spark.createDataFrame([(-1, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏" * 3, None, "src1", 60)], docs.schema))
    got = {r.id: r for r in langid.identify(langid.document_evidence(foreign)).collect()}
    assert not got[-1].kept and got[-1].lang == "und" and all(r.kept for i, r in got.items() if i >= 0)
    odd = {r.id: r for r in langid.identify(langid.document_evidence(odd_docs)).collect()}
    assert not odd[3].kept and not odd[4].kept and not odd[5].kept and odd[1].kept and odd[6].kept
    assert langid.identify(langid.document_evidence(empty_docs)).count() == 0


def test_language_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    truth = {r.page_id: r.url.split("/")[3] for r in pages.collect()}
    rows = langid.identify(langid.page_evidence(pages)).collect()
    assert len(rows) == len(truth) and sum(r.lang == truth[r.id] for r in rows) / len(rows) > 0.9
    assert {r.suffix for r in langid.page_evidence(pages).select("suffix").distinct().collect()} <= {"com", "org", "net"}


def test_language_evidence_moves_the_result(spark):
    """A text that says little goes by its declaration, without one by its host, without a known host by its suffix."""
    en, de = "the house and the garden were full of people who thought about the weather", "das haus und der garten waren voller menschen die an das wetter dachten"
    rows = [(i, en, "en", "e.com", "com") for i in range(30)] + [(100 + i, de, "de", "d.de", "de") for i in range(30)]
    rows += [(200, "ab", "de", "e.com", "com"), (201, "ab", None, "d.de", "de"), (202, "ab", None, "new.de", "de"), (203, "ab", None, "new.com", "com")]
    got = {r.id: r.lang for r in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string"), ("de", "en")).collect()}
    assert (got[201], got[202], got[203]) == ("de", "de", "en") and got[0] == "en" and got[100] == "de"


def test_surrogates_keep_form():
    key = b"k"
    text = ("Mr. John Smith and MRS? Mrs Maria Lopez wrote to ann.lee@mail.example.com, ANN.LEE@MAIL.EXAMPLE.COM, +1 (930) 555-2361 or (930) 555-2361, 8.20.209.178, 4111 1111 1111 1111, "
            "4111111111111112, 123-45-6789, Господин Иванов; DE89 3704 0044 0532 0130 00. Version 1.2 of 2024-01-02 costs 1234567.")
    new, n = surrogates.rewrite(text, key, {})
    for secret in ("John", "Smith", "Maria", "Lopez", "ann.lee", "ANN.LEE", "555-2361", "8.20.209.178", "4111", "123-45-6789", "Иванов", "0532"):
        assert secret not in new, secret
    assert "Version 1.2 of 2024-01-02 costs 1234567." in new and n >= 12
    mail = re.findall(r"[\w.+-]+@[\w.-]+\w", new)
    assert mail[1] == mail[0].upper()
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert surrogates.luhn(card) and not surrogates.luhn(re.search(r"(?<!\d)\d{16}(?!\d)", new)[0])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and surrogates.script(re.search(r"Господин (\w+)", new)[1]) == "cyrillic"
    first = re.search(r"Mr\. (\w+)", new)[1]
    assert first in surrogates.GIVEN["latin", "m"] and re.search(r"Mrs (\w+)", new)[1] in surrogates.GIVEN["latin", "f"]
    assert surrogates.rewrite(text, key, {})[0] == new != surrogates.rewrite(text, b"other", {})[0]


def test_surrogates_of_every_number_in_a_run():
    """Dates, expiry dates, slashes and several numbers in one run of digits leave no number behind."""
    runs = {"03/14/2024 555-123-4567": ["phone"], "555-123-4567 / 555-987-6543": ["phone", "phone"], "4111 1111 1111 1111 12/26": ["account"], "4111-1111-1111-1111 01/27 123": ["account"],
            "123-45-6789 555-123-4567": ["social", "phone"], "2024-01-02 123-45-6789": ["social"], "+44 20 7946 0958 555-123-4567": ["phone", "phone"],
            "+1 930-555-2361 +1 (930) 555-2362 4111111111111111": ["phone", "phone", "account"], "10.1.2.3/24 8.8.4.4": ["ip", "ip"], "8.20.209.178 / (930) 555-2361": ["ip", "phone"],
            "+1 930 555 2361 4111 1111 1111 1111": ["phone", "account"], "03/14/2024 12/26": [], "1.2.3.4.5 2024-01-02": [], "999.1.1.1 10 20": []}
    for run, kinds in runs.items():
        text = f"call {run}, then"
        assert [x[2] for x in surrogates.detect(text)] == kinds, (run, surrogates.detect(text))
        new = surrogates.rewrite(text, b"k", {})[0]
        for start, end, *_ in surrogates.detect(text):
            assert text[start:end] not in new, run
        assert len(new) == len(text) or "ip" in kinds


def test_surrogates_of_names_without_their_honorific():
    """Later mentions of a name get its surrogate; a title of any gender goes with the others of the text."""
    text = "Mr. John Smith called. Smith said, and John Smith signed; SMITH'S and smith's, Smithson. Dr. John Smith; Prof. Dr. Anna Kern, Kern; Herr Dr. Weber, Weber. Mr. Don Lord, Don Diego. Don"
    new = surrogates.rewrite(text, b"k", {})[0]
    first, last = re.match(r"Mr\. (\w+) (\w+) called", new).groups()
    assert first in surrogates.GIVEN["latin", "m"]
    assert new.startswith(f"Mr. {first} {last} called. {last} said, and {first} {last} signed; {last.upper()}'S and smith's, Smithson. Dr. {first} {last}; Prof. Dr. ")
    for name in ("John", "Smith ", "Anna", "Kern", "Weber", "Lord", "Diego"):
        assert name not in new, name
    assert re.search(r"Prof\. Dr\. \w+ (\w+), \1; Herr Dr\. (\w+), \2\.", new)
    assert surrogates.rewrite("He said. Yesterday Mr Smith and Maria came", b"k", {})[1] == 1
    assert surrogates.rewrite("Doctor no Smith, Will Mark Don", b"k", {})[1] == 0


def crowded(spark):
    """More addresses of one short format than chance keeps apart, and names that share a small pool."""
    rows = [(i, f"see a{i % 10}{i // 10 % 10}@x.example.com and Mr. Tom{chr(97 + i % 26)}{chr(97 + i // 26)} Berg, again a{i % 10}{i // 10 % 10}@x.example.com", "x") for i in range(100)]
    return spark.createDataFrame([*rows, (100, None, "n"), (101, "", "e"), (5, rows[5][1], "again"), (None, "clean text 12", "z")], "doc_id long, text string, n_entities string")


def test_surrogates_stay_distinct(spark):
    df = crowded(spark)
    table = surrogates.assign(surrogates.entities(df)).collect()
    assert len({(r.kind, r.surrogate) for r in table}) == len(table) and any(r.attempt > 0 for r in table)
    assert not {(r.kind, r.surrogate) for r in table} & {(r.kind, r.norm) for r in table}


def test_surrogates_broadcast_and_join_agree(spark):
    df = crowded(spark)
    a, b = ([tuple(r) for r in surrogates.replace(df, max_rows=m).collect()] for m in (100_000, 0))
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) == df.count()
    mails = collections.Counter(m for r in a for m in re.findall(r"\S+@\S+?com", r[1] or ""))
    assert len(mails) == 100 and min(mails.values()) == 2
    by = {r[0]: r for r in a}
    assert by[100][1] is None and by[101][1] == "" and by[None][1] == "clean text 12" and not by[None][3]


def test_surrogates_odd_rows(odd_docs, empty_docs):
    got = surrogates.replace(odd_docs).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=str)
    assert surrogates.replace(empty_docs).count() == 0


def planted_secrets(spark):
    import hashlib
    h = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'some words here then token = "{h(i)}" and more words follow here', "c") for i in range(60)]
    rows += [(100 + i, f"plain words about {'verylongcompoundword' * 2} and the usual things", "c") for i in range(60)]
    rows += [(200, f"{h(1)} {h(2)}", "c"), (201, None, "c"), (202, "", "c"), (None, f"api_key: {h(3)},{h(4)}", "c"), (203, "/usr/share/dictionary/words/and/other/files.txt", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, secret string")


def test_secret_forest(spark, empty_docs):
    got = secret_forest.scan(planted_secrets(spark)).collect()
    hexes = [r for r in got if re.fullmatch("[0-9a-f]{40}", r.secret)]
    assert len(hexes) == 64 and all(r.is_secret for r in hexes if r.doc_id is not None and r.doc_id < 100)
    assert not any(r.is_secret for r in got if r.secret.startswith("verylong")) and sum(r.secret.startswith("verylong") for r in got) == 60
    assert secret_forest.scan(empty_docs).count() == 0


def test_secret_forest_learns_held_out_labels(spark):
    """Labels of half the findings; the other half is judged right."""
    df = planted_secrets(spark).where("doc_id < 200")
    found = secret_forest.candidates(df)
    half = found.where(F.pmod("doc_id", F.lit(2)) == 0).withColumn("label", (F.col("doc_id") < 100).cast("int"))
    got = secret_forest.scan(df, labelled=half).where(F.pmod("doc_id", F.lit(2)) == 1).collect()
    assert len(got) == 60 and sum(r.is_secret == (r.doc_id < 100) for r in got) >= 57
    one = secret_forest.scan(df, labelled=half.where("label = 1")).collect()
    assert all(r.is_secret and r.probability == 1 for r in one)


def test_secret_scan_is_native(spark):
    plan = secret_forest.scan(planted_secrets(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lattice_report_decodes_what_was_encoded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two  three"), (1, "one two  three"), (None, None), (4, "zz\n\u00e9")], "doc_id long, text string")
    ids = {(r.row_key, r.sample): r.ids for r in lattice.encode(docs).collect()}
    got = lattice.report(docs).collect()
    assert all(r.round_trip and r.pieces == len(ids[r.row_key, r.sample]) for r in got)
    plain = lattice.decode
    monkeypatch.setattr(lattice, "decode", lambda *a: plain(*a).withColumn("text", F.concat("text", F.lit("!"))))
    assert not any(r.round_trip for r in lattice.report(docs).collect())


def test_lattice_hashes_only_the_races_of_its_walks(monkeypatch):
    vocab, hashed, mix = lattice.pieces(lattice.MODEL), [], lattice.mix
    monkeypatch.setattr(lattice, "mix", lambda x, *seed: hashed.append(np.size(x)) or mix(x, *seed))
    text = "the quick brown fox jumps over the lazy dog and runs away from here to straße 漢字 😀".encode()
    lattice.sample(vocab, [text], np.array([7], np.uint64), 2)
    assert sum(hashed) < 4 * len(text)      # about 2; 8 when pieces are looked up by hashes and the races of a walk are drawn again


def test_lattice_of_several_units_has_all_pieces():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL)
    named = {sp.id_to_piece(i).replace("▁", " ").encode(): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    vocab = lattice.pieces(lattice.MODEL)
    units = [x.encode() for x in (" there", "a", "straße漢字😀", "\0a\0", "▁", "   x", "ab" * 100, " Ünïcode")]
    lat = lattice.Lattice(vocab, units)
    for unit, start, end in zip(units, lat.start, lat.end):
        one = lattice.Lattice(vocab, [unit])
        todo, seen = [(int(start), 0)], {int(start): 0}
        for node, at in todo:
            edges = range(lat.first[node], lat.first[node + 1])
            got = [(int(lat.pid[e]), len(lattice.decode_ids(vocab, lat.pid[e:e + 1]))) for e in edges]
            inside = at and (unit[at] & 0xC0) == 0x80 if at < len(unit) else False
            want = [] if inside else [(named[unit[at:to]], to - at) for to in range(at + 1, len(unit) + 1) if unit[at:to] in named]
            char = at < len(unit) and len(unit[at:].decode("utf-8", "ignore")[:1].encode()) if not inside else 0
            if at < len(unit) and (inside or char not in [size for _, size in want]):
                want.append((int(vocab.byte_id[unit[at]]), 1))
            assert sorted(got) == sorted(want)
            for e, (_, size) in zip(edges, got):
                assert seen.setdefault(int(lat.dst[e]), at + size) == at + size
                if (int(lat.dst[e]), at + size) not in todo:
                    todo.append((int(lat.dst[e]), at + size))
            if got:
                assert abs(np.exp(lat.log_q[edges.start:edges.stop]).sum() - 1) < 1e-9
        assert seen[int(end)] == len(unit) and max(seen.values()) == len(unit) and one.end[0] - one.start[0] == len(unit)


def test_first_samples_do_not_depend_on_how_many_are_asked():
    vocab = lattice.pieces(lattice.MODEL)
    texts = [x.encode() for x in ("the quick brown fox " * 30, "ab c", "a", "", "  漢字 😀 ▁ straße", "x" * 400, "once upon a time there was")]
    keys = np.arange(len(texts)).astype(np.uint64)
    many = lattice.sample(vocab, texts, keys, 6)
    for k in (1, 2, 4):
        for few, all_ in zip(lattice.sample(vocab, texts, keys, k), many):
            assert [(x[0].tolist(), x[1]) for x in few] == [(x[0].tolist(), x[1]) for x in all_[:k]]

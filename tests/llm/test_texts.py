"""Decontamination, line dedup, surrogates and language: edge cases and brute force."""

import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

from graphloam.llm import decontaminate as dc
from graphloam.llm import lang_id, line_dedup, pii
from graphloam.llm import wordbytes as wb
from graphloam.llm.common import table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_word_bytes_are_those_of_the_pattern(monkeypatch):
    monkeypatch.setattr(wb, "PIECE", 64)  # many pieces
    text = ("Äh, ABC def9 " + "x" * 200 + " é\n\tz ") * 20
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, h = wb.words(wb.lower_bytes(data), wb.ALNUM)
    low = text.encode().lower()
    assert [low[a:b] for a, b in zip(s, e)] == WORD.findall(low)
    seen = {}
    for a, b, x in zip(s, e, h):
        assert seen.setdefault(low[a:b], x) == x
    assert len(set(seen.values())) == len(seen)
    look = wb.Lookup(np.sort(np.array(list(seen.values()))))
    assert (look.ordered[look.find(h)] == h).all() and (look.find(h + np.uint64(1)) == -1).all()


def brute(text, items):
    low = lambda t: [w.decode() for w in WORD.findall((t or "").encode().lower())]
    words, hit, found = low(text), set(), set()
    for item, body in items:
        gram = low(body)
        n = min(10, len(gram))
        grams = {tuple(gram[i : i + n]) for i in range(len(gram) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found |= {str(item)} - {"None"}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "Short item"), (2, "Short item"), (3, None), (4, "..."), (10, "b c d e f g h i j k"), (None, "p q r s t u v w x y z")]
TEXTS = [(1, None), (2, ""), (3, "A b, c D e f g h i j K l m"), (3, "A b, c D e f g h i j K l m"), (4, "short ITEM short item"), (5, "é " * 30_000 + "a b c d e f g h i j"), (None, "b c d e f g h i j"), (6, "p q r s t u v w x y z")]


def test_decontamination_against_brute_force(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    expected = {r.doc_id: brute(r.text, items) for r in docs.filter("doc_id % 4 = 0").collect()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in dc.digest(docs, bench).collect()}
    assert {k: got[k] for k in expected} == expected


def test_decontamination_edges_and_the_way_beyond_the_bound(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "'x' as hits", "1 as key", "2 as first")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted([brute(t, ITEMS)[:3] for _, t in TEXTS])
    for limit in (dc.MOST_WINDOWS, 0):
        found = dc.find_contamination(docs, bench, most_windows=limit)
        rows = found.collect()
        assert sorted((r.n_words, sum(x["last"] - x["first"] for x in r.hits), len(r["items"])) for r in rows) == expected
        assert all(r.contaminated == bool(r.hits) for r in rows)
    assert sorted((r.doc_id or 0) for r in dc.clean_documents(docs, bench).collect()) == [0, 1, 2]
    cut = {r.doc_id: r.text for r in dc.remove_spans(dc.find_contamination(docs, bench)).collect()}
    assert cut[3] == " m" and cut[1] is None and cut[6] == ""
    assert not dc.find_contamination(docs, bench.limit(0)).filter("contaminated").count()
    assert dc.digest(docs.limit(0), bench).count() == 0


def test_line_dedup_edges(spark):
    line = "This line is longer than forty characters, surely."
    rows = [(1, None), (2, ""), (3, f"a\n{line}\nb"), (4, f"\t{line.upper()} \n"), (5, line), (6, f"{line}\n{line}\n"), (7, line), (7, line), (None, line), (8, "short\n" * 5), (9, f"{line[:39]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _key", "2 as n_lines", "3 as _at")
    out = line_dedup.drop_repeated_lines(docs).collect()
    got = sorted((r.doc_id or 0, r.kept_text, r.n_lines, r.n_dropped) for r in out)
    assert got == sorted([(1, "", 1, 0), (2, "", 1, 0), (3, "a\nb", 3, 1), (4, "", 2, 1), (5, "", 1, 1), (6, "", 3, 2), (7, line, 1, 0), (7, line, 1, 0), (0, "", 1, 1), (8, "short\n" * 5, 6, 0), (9, line[:39], 1, 0)])
    assert line_dedup.digest(docs.limit(0)).count() == 0


def test_a_text_of_many_shared_lines_takes_seconds(spark):
    import time

    lines = [f"line number {i} is long enough to be counted as one" for i in range(100_000)]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(d, text + f"\nown {d}") for d in range(6)], "doc_id long, text string")
    start = time.perf_counter()
    out = {r.doc_id: r for r in line_dedup.digest(docs).collect()}
    assert time.perf_counter() - start < 60
    assert all((r.n_lines, r.n_dropped) == (100_001, 100_000 if d < 5 else 0) for d, r in out.items())
    assert out[0].kept_sha256 == hashlib.sha256(b"own 0").hexdigest()


def test_salted_join_beyond_the_bound(spark, sf, monkeypatch):
    from graphloam.llm import common

    docs = table(spark, sf, "documents")
    first = sorted(line_dedup.digest(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(line_dedup.digest(docs).collect()) == first


PII = [
    (1, "Mail Ann.Lee@corp.example.com or +1 (555) 010-7788, ann.lee@corp.example.com!"),
    (2, "Card 4111 1111 1111 1111, again 4111111111111111; ip 10.20.30.40, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00."),
    (3, "Mrs. Smith met Anna Berg and Mr Jones; Анна Иванова too. Clean words 12 and 3.14 stay."),
    (4, None), (5, ""), (6, "nothing here"), (1, "Mail Ann.Lee@corp.example.com or +1 (555) 010-7788, ann.lee@corp.example.com!"),
    (7, "word " * 50_000 + "call +1 (555) 010-7788"),
]


def test_surrogates(spark):
    docs = spark.createDataFrame(PII, "doc_id long, text string").selectExpr("*", "1 as kind", "2 as _h", "3 as canon")
    rows = pii.replace_entities(docs).collect()
    assert len(rows) == len(PII)
    by = {r.doc_id: r for r in rows}
    one = by[1]
    assert [e.kind for e in one.entities] == ["email", "phone", "email"]
    assert one.entities[0].surrogate == one.entities[2].surrogate and "@" in one.entities[0].surrogate  # spellings of one address
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one.entities[1].surrogate) and one.entities[1].surrogate != one.entities[1].entity
    two = {e.kind: e for e in by[2].entities}
    assert set(two) == {"card", "ip", "ssn", "iban"}
    cards = [e for e in by[2].entities if e.kind == "card"]
    assert cards[0].surrogate.replace(" ", "") == cards[1].surrogate and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", cards[0].surrogate)
    digits = [int(c) for c in reversed(cards[1].surrogate)]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    names = [e.surrogate for e in by[3].entities]
    female = {script: parts[2] for script, parts in pii.SYLLABLES.items()}
    assert names[0].startswith("Mrs. ") and names[1].split()[0].endswith(female["Latin"]) and names[2].startswith("Mr ") and names[3].split()[0].endswith(female["Cyrillic"])
    iban = re.sub(" ", "", two["iban"].surrogate)
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert by[3].clean_text.endswith("Clean words 12 and 3.14 stay.")
    assert by[4].clean_text is None and by[5].clean_text == "" and by[6].clean_text == "nothing here"
    assert by[7].entities[0].surrogate == one.entities[1].surrogate  # the same everywhere
    for r in rows:
        for e in r.entities:
            assert e.entity not in r.clean_text
    assert pii.digest(docs.limit(0)).count() == 0


def test_names_of_many_kinds_and_coreference(spark):
    texts = {
        1: "Frau Schmidt met Anna Schmidt and Dr. Schmidt; Prof. Dr. Angela Merkel was there.", 2: "My name is Priya Patel. Call +1 555 010 7788 or 555 010 7788.", 3: "Sincerely, Yuki Tanaka", 4: "田中様 и г-н Петров; Имя: Ольга Петров",
        5: "Name: ישראל כהן", 6: "a@corp.example b@corp.example c@other.example", 7: "10.0.0.1 192.168.4.4 8.8.8.8", 8: "Anna\nBerg and Anna Berg",
    }
    by = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    family = lambda e: e.surrogate.split()[-1]
    one = by[1].entities
    assert [e.entity for e in one] == ["Frau Schmidt", "Anna Schmidt", "Dr. Schmidt", "Prof. Dr. Angela Merkel"] and len({family(e) for e in one[:3]}) == 1 and family(one[3]) != family(one[0])
    assert one[0].surrogate.startswith("Frau ") and one[3].surrogate.startswith("Prof. Dr. ") and "Schmidt" not in by[1].clean_text
    name, long, short = by[2].entities
    assert name.entity == "Priya Patel" and long.surrogate == "+1 " + short.surrogate
    assert [e.entity for e in by[3].entities] == ["Yuki Tanaka"]
    assert [e.entity for e in by[4].entities] == ["田中", "г-н Петров", "Ольга Петров"] and by[4].clean_text[2:3] == "様"
    assert family(by[4].entities[1]) == family(by[4].entities[2]) and re.fullmatch("[А-Яа-я -]+", by[4].entities[2].surrogate)
    assert re.fullmatch("[א-ת]+ [א-ת]+", by[5].entities[0].surrogate)
    a, b, c = (e.surrogate.split("@")[1] for e in by[6].entities)
    assert a == b != c
    assert by[7].entities[0].surrogate.startswith("10.") and by[7].entities[1].surrogate.startswith("192.168.") and not re.match(r"(10|127|192\.168)\.", by[7].entities[2].surrogate)
    assert [e.entity for e in by[8].entities] == ["Anna Berg"] and by[8].clean_text.startswith("Anna\nBerg and ")


def plain_entities(text):
    """(start, end, kind) by trying each pattern at each place."""
    import regex

    java = lambda p: regex.compile(p.replace("IsHan}", "Han}").replace("IsHangul}", "Hangul}").replace("\\d", "[0-9]").replace("\\w", "[A-Za-z0-9_]"))
    patterns, out, at = [(k, java(p)) for k, p in pii.PATTERNS], [], 0
    while at < len(text):
        for kind, pattern in patterns:
            m = pattern.match(text, at)
            if m and m.end() > at:
                out.append((at, m.end(), kind))
                at = m.end() - 1
                break
        at += 1
    return out


def test_surrogates_against_brute_force(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(PII[:6], "doc_id long, text string"))
    for rows_at_most in (pii.BROADCAST_ROWS, 0):  # broadcast lists, and the way beyond the bound
        monkeypatch.setattr(pii, "BROADCAST_ROWS", rows_at_most)
        rows = pii.replace_entities(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = plain_entities(r.text or "")
            assert [(e.kind, e.entity) for e in r.entities] == [(k, r.text[a:b]) for a, b, k in want]
            made, last = "", 0
            for (a, b, _), e in zip(want, r.entities, strict=True):
                made, last = made + r.text[last:a] + e.surrogate, b
            assert r.clean_text == (None if r.text is None else made + r.text[last:])
        there, back = {}, {}
        for kind, entity, surrogate in {(e.kind, e.entity, e.surrogate) for r in rows for e in r.entities}:
            if kind not in ("phone", "name"):
                bare = lambda x: re.sub("[^0-9a-z@.]" if kind == "email" else "[^0-9a-z]", "", x.lower())  # noqa: B023, E731
                assert there.setdefault((kind, bare(entity)), bare(surrogate)) == bare(surrogate) and back.setdefault((kind, bare(surrogate)), bare(entity)) == bare(entity)
        real = {(k, e) for k, e in there}
        assert not real & {(k, v) for (k, _), v in there.items()}


def test_types_are_tried_by_first_character_as_in_turn(spark):
    rng = np.random.default_rng(7)
    names, titles, cues = pii.FEMALE + pii.MALE_CYRILLIC, pii.MALE_TITLES + pii.OTHER_TITLES, [*pii.CUES, *pii.CUES_WITHOUT_CASE]
    numbers = ["123-45-6789", "4111 1111 1111 1111", "10.0.0.1", "v1.2.3.4", "+1 (555) 010-7788", "(030) 1234 5678", "+4915112345678", "DE89 3704 0044 0532 0130 00", "3.14", "1.1.1.1.1"]
    words = ["Smith", "O'Brien", "Über", "Жуков", "d'Or", "X", "ªªª", "田中様", "山田さん", "김철수씨", "々々様", "〇〇様", "ᄀᄀ様", "ישראל", "z田氏"]
    mails = ["a.b@c.de", "A1+2@h-i.example.com", "@", "a@b", "é@x.com", "1@2.com"]
    texts = []
    for i in range(600):
        kinds = [names, titles, cues, numbers, words, [" ", ", ", "-", "+", "(", "’", "："], mails][: 6 + i % 2]  # every second text may have an @
        texts.append((i, "".join(str(rng.choice(kinds[rng.integers(len(kinds))])) + " " * int(rng.integers(2)) for _ in range(rng.integers(2, 12)))))
    every = lambda t, p: F.regexp_extract_all(t, p, 0)
    rows = spark.createDataFrame(texts, "i long, text string").select("text", pii.by_pattern(F.col("text"), every).alias("e"), every(F.col("text"), F.lit(pii.PATTERN)).alias("whole"), every(F.col("text"), F.lit("|".join(f"(?:{p})" for _, p in pii.PATTERNS))).alias("in_turn")).collect()
    assert len(rows) == 600 and sum("@" in r.text for r in rows) > 100 and sum(len(r.e) for r in rows) > 600
    assert all(r.e == r.whole == r.in_turn for r in rows)


def test_search_costs_a_few_times_that_of_one_class(spark):
    words = "the Quick brown fox über Straße naïve jumps over Lazy dogs and El niño, then A few more. "
    docs = spark.range(64).repartition(8).select(F.concat(F.lit(words * 8000), F.col("id").cast("string")).alias("text")).cache()
    docs.count()

    def seconds(found):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            docs.agg(F.sum(F.size(found))).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    every = lambda t, p: F.regexp_extract_all(t, p, 0)
    assert seconds(pii.by_pattern(F.col("text"), every)) < 7 * seconds(every(F.col("text"), F.lit("[A-Z0-9]!")))
    docs.unpersist()


def test_entities_are_drawn_on_all_cores(spark, monkeypatch):
    tasks, settle = [], pii.settle

    def noted(df):
        out = settle(df)
        if {"gender", "surrogate"} <= set(out.columns):
            tasks.append(out.select(F.spark_partition_id()).distinct().count())
        return out

    monkeypatch.setattr(pii, "settle", noted)
    entities = spark.range(4000).selectExpr("'phone' as kind", "cast(2000000000 + id * 7919 as string) as canon", "0 as gender")
    made = pii.surrogate_table(entities, "k").collect()
    assert len({r.surrogate for r in made}) == 4000 and tasks[0] == spark.sparkContext.defaultParallelism


def test_many_texts_with_entities_are_told_by_hash_or_search(spark, monkeypatch):
    docs = spark.createDataFrame(PII[:6] + [(8, PII[0][1]), (9, None), (10, "clean")], "doc_id long, text string")
    rows = lambda: sorted((r.doc_id, r.n_entities, r.kinds, str(r.text)) for r in pii.digest(docs).collect())
    searched = lambda: "RLIKE" in pii.digest(docs)._jdf.queryExecution().optimizedPlan().toString()
    want = rows()
    assert sum(n for _, n, _, _ in want) == 15
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert rows() == want and not searched()
    monkeypatch.setattr(pii, "KEYS", 0, raising=False)
    assert rows() == want and searched()


def test_given_names_keep_their_gender_when_all_listed_ones_occur(spark):
    rows = [(i, f"{n} Okonkwo") for i, n in enumerate([*pii.FEMALE, *pii.MALE, *pii.FEMALE_CYRILLIC, *pii.MALE_CYRILLIC])]
    made = [r.clean_text.split()[0] for r in sorted(pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
    listed = {t.split()[0] for _, t in rows}
    assert len(set(made)) == len(rows) and not set(made) & listed
    ends, at = [], 0
    for script, names in (("Latin", (pii.FEMALE, pii.MALE)), ("Cyrillic", (pii.FEMALE_CYRILLIC, pii.MALE_CYRILLIC))):
        for gender, of in enumerate(names):
            ends += [pii.SYLLABLES[script][2 + gender]] * len(of)
    assert all(m.endswith(e) for m, e in zip(made, ends, strict=True))


def test_names_with_second_capitals_and_of_any_length(spark):
    long = "W" + "o" * 200
    rows = [(1, "Mr. O'Brien came."), (2, "Mrs McDonald and Dr. MacLeod-Smith left."), (3, f"Signed: Herr {long}, today"), (4, "name is Anna O’Neill")]
    found = {r.doc_id: [e.entity for e in r.entities] for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ["Mr. O'Brien"], 2: ["Mrs McDonald", "Dr. MacLeod-Smith"], 3: [f"Herr {long}"], 4: ["Anna O’Neill"]}


def test_surrogates_never_collide(spark):
    entities = spark.range(600).selectExpr("'given' as kind", "concat(char(65 + id % 26), lower(hex(id))) as canon", "cast(id % 3 as int) as gender")
    made = pii.surrogate_table(entities, "k").collect()
    assert len(made) == 600 and len({r.surrogate for r in made}) == 600
    assert not {r.surrogate for r in made} & {r.canon for r in made}


def test_kinds_with_few_surrogates_never_run_out(spark):
    # all addresses of one private block, and more short mail addresses than their shape has
    blocks = spark.range(0, 65_536, 2).selectExpr("'ip' as kind", "concat('192.168.', cast(id div 256 as string), '.', cast(id % 256 as string)) as canon", "0 as gender")
    mails = spark.range(36).selectExpr("'email' as kind", "concat(substr('abcdefghijklmnopqrstuvwxyz0123456789', cast(id as int) + 1, 1), '@one.example') as canon", "0 as gender")
    made = pii.surrogate_table(blocks.unionByName(mails), "k").collect()
    assert len(made) == 32_804 and len({r.surrogate for r in made}) == 32_804 and not {r.surrogate for r in made} & {r.canon for r in made}
    assert len({r.surrogate.split("@")[1] for r in made if r.kind == "email"}) == 1


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right / len(rows) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def plain_grams(text):
    words = re.split(r"[^a-z\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().decode("latin-1"))
    return [w[i : i + n] for w in (f" {w} " for w in words if w) for n in (2, 3, 4) for i in range(len(w) - n + 1)]


def test_language_against_brute_force(spark, sf):
    # the same rules with exact sets in place of Bloom filters
    import zlib
    from collections import Counter

    rows = table(spark, sf, "documents").select("doc_id", "text", "lang").collect()
    counts = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang and r.text:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    rate = {x: {g: n / c.total() for g, n in c.items()} for x, c in counts.items()}
    most = Counter()
    for c in rate.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    typical = {x: {g for g, n in c.items() if n >= 3 and rate[x][g] >= 0.5 * most[g]} for x, c in counts.items()}
    assert all(len(t) < lang_id.GRAMS for t in typical.values())
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(table(spark, sf, "documents")).collect()}
    same = 0
    for r in rows:
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert got[r.doc_id] == ("und", 0.0)
            same += 1
            continue
        found = plain_grams(r.text)
        share = {x: sum(g in t for g in found) / len(found) for x, t in typical.items()}
        best = max(sorted(share), key=lambda x: share[x])
        same += got[r.doc_id][0] == best
        assert abs(got[r.doc_id][1] - share[got[r.doc_id][0]]) < 0.02 and share[best] - share[got[r.doc_id][0]] < 0.02
    assert same >= 0.98 * len(rows)


def test_junk_and_unlearned_languages_are_rejected(spark):
    import random

    rng = random.Random(6)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(400)), "xq zzkw qqq vvx jjk", "Все люди рождаются свободными и равными", "すべての人間は", "123 ..."]
    more = spark.createDataFrame([(10**7 + i, t, None, "web", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in lang_id.known_language(docs.unionByName(more)).collect()}
    assert not [d for d in kept if d >= 10**7]
    assert kept == {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}


def test_language_edges(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "123 ...", "en"), (None, "the and of that", None), (None, "ℵ", "xx"), (10**6 + 3, "the " * 100_000, "en")], docs.schema)
    out = {}
    for r in lang_id.predict(docs.unionByName(extra).withColumn("score", F.lit("x")).withColumn("_text", F.lit(1)), lang_id.train(docs, F.lit(True))).collect():
        out[(r.doc_id, r.text[:5] if r.text else r.text)] = (r.lang_pred, r.score)
    assert out[10**6, None] == out[10**6 + 1, ""] == out[10**6 + 2, "123 ."] == ("und", 0.0)
    assert out[None, "the a"][0] == "en" and out[10**6 + 3, "the t"][0] == "en" and out[None, "ℵ"][1] == 0.0
    assert lang_id.identify(docs.limit(0)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lang_id.identify(none).collect()} == {"und"}


def test_filters_tell_all_languages_of_a_gram():
    a, b = lang_id.grams([np.frombuffer(b"alpha beta", np.uint8)])[0], lang_id.grams([np.frombuffer(b"beta gamma", np.uint8)])[0]
    f = lang_id.build_filters({f"l{i:02d}": (a if i % 2 else b) for i in range(70)})  # more than one word of bits
    counts, total = f.counts([np.frombuffer(b"beta", np.uint8), None, np.frombuffer(b"alpha", np.uint8)])
    assert (counts[0] > 0.9 * total[0]).all() and total[1] == 0
    assert counts[2, 1] > counts[2, 0] and (counts[2, 1::2] > counts[2, 0]).all()

import random

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import decontaminate as d

from .docs import ODD, empty, frame

ITEMS = [
    (1, "Alice has 12 apples and gives 5 km of rope to Bob before the long night. How many apples does Alice keep after Bob eats 3 of them today?"),
    (2, "the slow green river carries small boats past the old mill every single morning in spring"),
    (3, "too short item"),
    (4, None),
    (5, "repeat one two three four five repeat one two three four five six seven eight nine ten eleven"),
]
FILLER = [f"f{i}" for i in range(500)]


def around(rnd, text):
    return " ".join(rnd.sample(FILLER, 40)) + " " + text + "\n" + " ".join(rnd.sample(FILLER, 40))


def planted():
    rnd = random.Random(4)
    a, b = ITEMS[0][1], ITEMS[1][1]
    new = a.replace("Alice", "Carla").replace("Bob", "Daniel").replace("12", "47").replace("5 km", "9 miles").replace(" 3 ", " 8 ")
    mixed, k = [], 0
    for w in a.split():  # every slot gets a value of its own: not a question of that template
        k += 1
        mixed.append(f"Name{chr(97 + k % 26)}{chr(97 + k // 26)}x" if w in ("Alice", "Bob") else w)
    return [
        (100, around(rnd, a), {1}),
        (101, around(rnd, new), {1}),
        (102, around(rnd, b.upper()), {2}),
        (103, around(rnd, ", ".join(b.split())), {2}),
        (104, around(rnd, a + " " + b), {1, 2}),
        (105, around(rnd, " ".join(b.split()[:8])), set()),
        (106, around(rnd, "too short item"), set()),
        (107, around(rnd, ""), set()),
        (108, around(rnd, ITEMS[4][1]), {5}),
        (None, around(rnd, a), {1}),
    ]


@pytest.mark.parametrize("limit", [d.BROADCAST_WINDOWS, 0])
def test_planted_items_are_found(spark, limit):
    rows = planted()
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("doc", F.lit("clash")).withColumn("hash", F.lit("clash"))
    docs = frame(spark, [r[:2] for r in rows] + ODD).withColumn("item_id", F.lit("clash"))
    texts = {k: t for k, t, _ in rows}
    found = {}
    for r in d.contaminated(docs, items, broadcast_windows=limit).collect():
        found.setdefault(r["doc_id"], set()).add(r["item_id"])
        span = texts[r["doc_id"]][r["start"] : r["end"]]
        assert len(span.split()) <= len((dict(ITEMS)[r["item_id"]]).split()) and span[0] != " "
    assert found == {k: want for k, _, want in rows if want}


def test_slots_must_be_consistent(spark):
    item = "Anna met Bert while Anna saw Bert and then Anna told Bert that Anna likes what Bert cooks when Anna visits"
    steady = item.replace("Anna", "Carl").replace("Bert", "Dora")
    loose, k = [], 0
    for w in item.split():
        k += w in ("Anna", "Bert")
        loose.append(f"Z{chr(97 + k)}y" if w in ("Anna", "Bert") else w)
    docs = spark.createDataFrame([(1, steady), (2, " ".join(loose)), (3, item)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in d.contaminated(docs, items).collect()}
    assert set(got) == {1, 3} and got[1]["kind"] == 1 and got[1]["consistency"] == 1


def test_edited_and_partial_copies_are_found(spark):
    rnd = random.Random(9)
    short, long = ITEMS[1][1], " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(38))

    def edited(text, *places):
        words = text.split()
        for k in places:
            words[k] = "changed"
        return " ".join(words)

    w = long.split()
    rows = [
        (1, edited(short, 8), {2}),
        (2, edited(long, 12, 25), {9}),
        (3, " ".join(w[5:20]), {9}),  # 15 of 38 words
        (4, " ".join(w[:9] + w[14:30] + ["put", "in"] + w[30:]), {9}),
        (5, " ".join(w[20:29]), set()),
        (6, edited(long, *range(0, 38, 4)), set()),
    ]
    docs = spark.createDataFrame([(k, around(rnd, text)) for k, text, _ in rows], "doc_id bigint, text string")
    items = spark.createDataFrame([*ITEMS, (9, long)], "item_id bigint, text string")
    found = {k: set() for k, _, _ in rows}
    for r in d.contaminated(docs, items).collect():
        found[r["doc_id"]].add(r["item_id"])
    assert found == {k: want for k, _, want in rows}
    assert sorted(r["doc_id"] for r in d.clean_documents(docs, items).collect()) == [5, 6]


def test_parts_in_another_order_are_found(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(72)]
    parts = [words[k : k + 36] for k in range(0, 72, 36)]
    docs = spark.createDataFrame([(1, " ".join(parts[1] + parts[0]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    assert [r["matched"] for r in d.contaminated(docs, items, run=99, template_run=99).collect()] == [64]


def test_each_occurrence_is_consistent_by_itself(spark):
    rnd = random.Random(3)
    item = ITEMS[0][1]

    def variant(a, b, n, k):
        return item.replace("Alice", a).replace("Bob", b).replace("12", str(n)).replace("5 km", f"{k} miles").replace(" 3 ", f" {k + 1} ")

    bank = [variant("Carla", "Daniel", 47, 9), variant("Erika", "Frank", 71, 4), variant("Gina", "Henry", 33, 6)]
    rows = [(1, "\n".join(bank[:2])), (2, "\n".join(bank)), (3, around(rnd, bank[0]) + around(rnd, bank[1])), (4, around(rnd, bank[2]))]
    docs, items = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in d.contaminated(docs, items).collect()}
    assert set(got) == {1, 2, 3, 4} and all(r["item_id"] == 1 and r["kind"] == 1 and r["consistency"] == 1 for r in got.values())
    assert all(len(dict(rows)[k][r["start"] : r["end"]].split()) <= len(item.split()) for k, r in got.items())


def brute_plain(docs, items, size, percent):
    """By plain windows alone, with Python's own string methods."""

    def words(t):
        out = []
        for w in (t or "").split():
            core = w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
            out.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in core or w))
        return out

    def wins(t):
        w = words(t)
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    item_sets = {i: wins(t) for i, t in items}
    out = set()
    for k, t in docs:
        own = wins(t)
        out |= {(k, i) for i, s in item_sets.items() if s and 100 * len(s & own) >= percent * len(s)}
    return out


def test_table_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 5, 80)
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).collect()}
    assert want and got == want
    kept = {r["doc_id"] for r in d.clean_documents(docs, items).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {k for k, _ in want}


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert d.contaminated(empty(spark), items).collect() == []
    assert d.contaminated(frame(spark), items.filter("1 = 0")).collect() == []
    assert d.clean_documents(frame(spark), items.filter("1 = 0")).count() == len(ODD)


def test_clean_rows_of_a_shared_id_stay(spark):
    item = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(None, f"see {item} here"), (None, "clean without an id"), (4, item), (4, "clean text of the same id"), (5, None)], "doc_id bigint, text string").withColumn("text_key", F.lit("clash"))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["text"], r["text_key"]) for r in d.clean_documents(docs, items).collect())
    assert got == [("4", "clean text of the same id", "clash"), ("5", None, "clash"), ("None", "clean without an id", "clash")]


def test_a_bank_of_one_template_is_one_class(spark):
    names = [f"{a}{b}na" for a in "ABCDEFGHIJKLMNOPQRST" for b in "aeiou"]
    text = "{0} has {2} apples and gives them to {1} before the long night so how many apples does {0} keep after {1} eats 3 of them".format
    bank = [(k, text(names[k], names[-1 - k], k + 5)) for k in range(40)]
    other = [(90, text("Zora", "Zora", 7)), (91, text("Zora", "Yara", 3))]  # slots with other equal values: classes of their own
    docs = spark.createDataFrame([(k, text(names[50 + k % 20], names[k], 1000 + k)) for k in range(60)], "doc_id bigint, text string")
    items = spark.createDataFrame(bank + other, "item_id bigint, text string")
    members = {}
    for r in d.item_members(items).filter("kind = 1").collect():
        members.setdefault(r["item_id"], set()).add(r["member"])
    assert members == {0: set(range(40)), 90: {90}, 91: {91}}
    got = d.contaminated(docs, items).collect()
    assert {r["doc_id"] for r in got if r["item_id"] == 0} == set(range(60)) and len(got) <= 60 * 3
    assert all(r["n_items"] == len(members[r["item_id"]]) and r["kind"] == 1 for r in got)


def brute_template(doc, item):
    """Whether a stretch of the document has the item's template and, in four of five slots that windows cover, one answer to each value."""

    def canonical(t):
        return [("#" if any(c.isdigit() for c in w) else "@" if w[0].isupper() and w[1:2].islower() else w, w.lower()) for w in t.split()]

    own, want = canonical(doc), canonical(item)
    for at in range(len(own) - len(want) + 1):
        part = own[at : at + len(want)]
        if [a for a, _ in part] == [a for a, _ in want]:
            # slots of windows of five words that have two plain ones
            wins = [range(k, k + 5) for k in range(len(want) - 4) if sum(want[j][0] not in "#@" for j in range(k, k + 5)) >= 2]
            # each place once, as in an occurrence, or once for each window, as for windows in any order
            for places in (sorted({j for w in wins for j in w}), [j for w in wins for j in w]):
                answers, slots = {}, [(want[j][1], part[j][1]) for j in places if want[j][0] in "#@"]
                for v, x in slots:
                    answers.setdefault(v, []).append(x)
                if 100 * sum(max(xs.count(x) for x in xs) for xs in answers.values()) >= 80 * len(slots):
                    return True
    return False


def test_reparameterised_questions_against_brute_force(spark):
    rnd = random.Random(12)
    plain = ["when", "every", "worker", "carries", "boxes", "toward", "the", "store", "and", "counts", "them", "slowly", "before", "lunch"]
    names = [a + b + "o" for a in "BCDFGHKLMN" for b in "aeiu"]
    items = []
    for k in range(25):
        who, nums = rnd.sample(names, 3), [str(rnd.randint(2, 99)) for _ in range(3)]
        words = [rnd.choice(plain) for _ in range(20)]
        for at in rnd.sample(range(20), 7):
            words[at] = rnd.choice(who + nums)
        items.append((k, " ".join(words)))
    docs = []
    for k in range(150):
        words, swap = rnd.choice(items)[1].split(), {}
        fresh = iter(rnd.sample(names, 20))
        for at, w in enumerate(words):
            if w[0].isupper() or w.isdigit():
                steady = k % 3 or rnd.random() < 0.3
                new = str(rnd.randint(100, 999)) if w.isdigit() else next(fresh)
                words[at] = swap.setdefault(w, new) if steady else new
        docs.append((k, around(rnd, " ".join(words))))
    found = {}
    bank = spark.createDataFrame(items, "item_id bigint, text string")
    for r in d.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bank, percent=80, template_run=99, run=99).collect():
        found.setdefault(r["doc_id"], set()).add(r["item_id"])
    want = {k: {i for i, t in items if brute_template(text, t)} for k, text in docs}
    assert found == {k: v for k, v in want.items() if v}
    assert sum(map(bool, want.values())) > 90 and not all(want.values())


@pytest.mark.parametrize("limit", [d.BROADCAST_WINDOWS, 0])
def test_short_items_are_found_as_whole_texts(spark, limit):
    rows = [(1, "Too short, ITEM!"), (2, "a too short item"), (3, "too short"), (4, "  too\nshort\titem "), (5, "one"), (6, "too short item too short item"), (None, "too short item"), (7, ""), (8, None), (9, ITEMS[1][1])]
    docs, items = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*ITEMS, (6, "too short item"), (8, "")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in d.contaminated(docs, items, short=True, broadcast_windows=limit).collect()}
    assert {k: r["item_id"] for k, r in got.items()} == {1: 3, 4: 3, None: 3, 9: 2}
    assert all((r["kind"], r["n_items"], r["matched"], r["windows"]) == (2, 2, 1, 1) for k, r in got.items() if k != 9)
    assert got[4]["start"] == 2 and got[4]["end"] == 16
    assert {r["doc_id"] for r in d.contaminated(docs, items, broadcast_windows=limit).collect()} == {9}
    assert sorted(str(r["doc_id"]) for r in d.clean_documents(docs, items, short=True).collect()) == ["2", "3", "5", "6", "7", "8"]

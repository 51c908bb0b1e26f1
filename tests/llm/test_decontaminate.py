import random

from helpers import collect, documents, messy_rows, words
from quarry.llm import decontaminate as D

ITEM = "In March Alice bought 12 kg of apples for 3 euros while Bob bought 12 kg of pears for 5 euros each day of the year."


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, leaks int")


def test_verbatim_and_reparameterised(spark):
    same = f"{words(50, 1)} {ITEM} {words(50, 2)}"
    other = "Noise. In March Carol bought 17 kg of apples for 4 euros while Dave bought 17 kg of pears for 9 euros each day of the year. Bye."
    broken = "Noise. In March Carol bought 17 kg of apples for 4 euros while Carol bought 18 kg of pears for 9 euros each day of the year. Bye."
    docs = documents(spark, [(1, same), (2, other), (3, broken), (4, words(200, 3)), (5, same.upper()), (5, same.upper())])
    got = collect(D.find_leaks(docs, bench(spark, [(7, ITEM), (8, words(30, 9))])), "doc_id", "item_id", "verbatim")
    assert (1, 7, True) in got and (2, 7, False) in got
    assert not any(g[0] in (3, 4) for g in got)


def test_equals_brute_force_on_plain_words(spark):
    items = [(i, words(12 + i, 100 + i)) for i in range(20)] + [(50, "too short"), (51, None), (52, ""), (53, "12 13 14 15 16 17 18 19 20")]
    rows = [(i, f"{words(40, i)} {items[i % 20][1]} {words(40, i + 1)}" if i % 3 == 0 else words(120, i)) for i in range(60)]
    rows += [(90, f"it is too short here"), (91, items[5][1][: len(items[5][1]) // 2]), (92, "12 13 14 15 16 17 18 19 20")]
    got = set(collect(D.find_leaks(documents(spark, rows), bench(spark, items)), "doc_id", "item_id"))

    def grams(text, n):
        ws = text.split()
        return [tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)]

    want = set()
    for i, text in rows:
        for item, other in items[:21]:
            n = min(8, len(other.split()))
            theirs = grams(other, n)
            if sum(g in set(grams(text, n)) for g in theirs) >= 0.5 * len(theirs):
                want.add((i, item))
    assert got == want | {(92, 53)} and len(want) > 20


def test_numbers_alone_are_found_verbatim_only(spark):
    items = [(1, "11 12 13 14 15 16 17 18 19 20 21 22 23 24"), (2, "7"), (3, "81 + 82 = 83"), (4, "Alice Bob Carol Dave")]
    rows = [(1, items[0][1]), (2, f"{words(9, 1)} {items[0][1]} {words(9, 2)}"), (3, "31 32 33 34 35 36 37 38 39 40 41 42 43 44"), (4, "seven 7 and 7"), (5, "so 81 + 82 = 83 ."), (6, "so 81 + 82 = 84 ."), (7, "was Alice Bob Carol Dave here"), (8, "was Alice Bob Carol Erin here")]
    assert collect(D.find_leaks(documents(spark, rows), bench(spark, items)), "doc_id", "item_id") == [(1, 1), (2, 1), (5, 3), (7, 4)]


def brute_leaks(text, item):
    """Windows of canonical tokens by comparison, one diagonal at a time. Tokens are
    lower-case words, whole numbers and title-case names, never two slots in a row."""

    def read(t):
        out, ended = [], True
        for w in t.split():
            bare = w.strip(".,")
            slot = "number" if bare.isdigit() else "name" if bare[:1].isupper() and not ended else None
            out.append((slot or bare.lower(), bare.lower(), slot is not None))
            ended = w.endswith(".")
        return out

    mine, theirs = read(text), read(item)
    places = [k for k in range(len(theirs) - 7) if sum(not slot for _, _, slot in theirs[k : k + 8]) >= 4]
    for shift in range(-len(theirs), len(mine)):
        hit = [k for k in places if k + shift >= 0 and [c for c, _, _ in theirs[k : k + 8]] == [c for c, _, _ in mine[k + shift : k + shift + 8]]]
        pairs = {(theirs[k + j][1], mine[k + j + shift][1]) for k in hit for j in range(8)}
        if hit and len(hit) >= 0.5 * len(places) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
            return True
    return False


def test_templates_and_slots_equal_brute_force(spark):
    draw = random.Random(11)

    def question(seed):
        at, parts = random.Random(seed), []
        for _ in range(at.randint(5, 9)):
            parts += [f"w{chr(97 + at.randrange(26))}{chr(97 + at.randrange(26))}" for _ in range(at.randint(2, 4))]
            parts.append(at.choice(["{}", "<>"]))
        return " ".join(parts + ["done."])

    def filled(shape, numbers, names):
        return " ".join(str(draw.choice(numbers)) if w == "{}" else draw.choice(names) if w == "<>" else w for w in shape.split())

    names = ["Alice", "Bob", "Carol", "Dave", "Erin"]
    shapes = [question(s) for s in range(12)]
    items = [(k, filled(shape, range(10, 14), names[:3])) for k, shape in enumerate(shapes)]
    rows = []
    for i in range(150):
        shape = shapes[i % 12]
        kind = i // 12 % 5
        if kind == 0:
            mid = items[i % 12][1]
        elif kind == 1:  # other values, consistently
            turn = dict(zip(map(str, range(10, 14)), draw.sample(range(50, 99), 4))) | dict(zip(names, draw.sample(names, 5)))
            mid = " ".join(str(turn.get(w, w)) for w in items[i % 12][1].split())
        elif kind == 2:  # other values, mostly inconsistent
            mid = filled(shape, range(10, 14), names)
        elif kind == 3:
            half = items[i % 12][1].split()
            mid = " ".join(half[: draw.randint(4, len(half))])
        else:
            mid = ""
        rows.append((i, f"{words(9, i, 90)} {mid} {words(9, i + 500, 90)}".replace("w", "v") if not mid else f"before it {mid} after it"))
    got = set(collect(D.find_leaks(documents(spark, rows), bench(spark, items)), "doc_id", "item_id"))
    want = {(i, k) for i, text in rows for k, item in items if brute_leaks(text, item)}
    assert got == want and 40 < len(want) < 120


def test_messy_rows(spark):
    docs = documents(spark)
    items = bench(spark, [(1, messy_rows()[9][1]), (1, messy_rows()[9][1]), (None, words(40, 4)), (2, "one")])
    whole = D.annotate(docs, items)
    assert whole.count() == 15
    leaks = collect(D.find_leaks(docs, items), "doc_id", "item_id")
    assert {8, 9, 10, None} <= {i for i, item in leaks if item == 1}
    assert collect(D.find_leaks(docs, items), "doc_id", "item_id") == leaks
    assert D.annotate(docs, items.limit(0)).where("size(leaks) > 0").count() == 0
    assert D.find_leaks(documents(spark, []).limit(0), items).count() == 0


def test_inserted_tokens_and_longer_names_are_found(spark):
    item = f"{words(19, 1)} Paris {words(18, 2)}"
    changed = [item.replace("Paris", "New York"), item.replace("Paris", "Paris inserted"), item.replace(" Paris", ""), item.replace("Paris", "The Big New York")]
    docs = documents(spark, [(i, f"{words(30, 40 + i)} {t} {words(30, 50 + i)}") for i, t in enumerate(changed)] + [(9, words(120, 60))])
    assert collect(D.find_leaks(docs, bench(spark, [(1, item)])), "doc_id", "item_id", "verbatim") == [(i, 1, False) for i in range(4)]


def test_verbatim_items_of_few_literals_are_found(spark):
    items = [(1, "What is 12 + 35?"), (2, "What is the capital of France?"), (3, "How Many Red Apples Did Alice Buy On Her Long Walk With Uncle Bob Today?")]
    rows = [(i, f"{words(20, i)} {text} {words(20, i + 9)}") for i, text in items] + [(7, f"{words(20, 7)} What is 12 + 36? {words(20, 8)}"), (8, words(60, 9))]
    got = collect(D.find_leaks(documents(spark, rows), bench(spark, items)), "doc_id", "item_id")
    assert {(1, 1), (2, 2), (3, 3)} <= set(got) and not any(d == 8 for d, _ in got)

import random
import re
from collections import Counter

from factloom.llm import decontaminate as d


def words(text):
    return [t for t in d.TOKEN.findall(text or "") if t not in ".!?\n"]


def test_documents_as_brute_force(spark, sf):
    """Items whose words stand in a document, in a row, in any letter case: those are found, and no other document."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()}
    texts = {r.doc_id: " " + " ".join(words(r.text)).lower() + " " for r in docs.collect()}
    want = {(i, b.item_id) for b in items.collect() for i, t in texts.items() if " " + " ".join(words(b.text)).lower() + " " in t}
    assert want and got == want


ITEM = "If Tom buys 12 apples for 3 dollars each and later sells 5 apples to Mary, how much money did Tom spend on all the apples together"


def leak(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in d.leaks(docs, bench).collect()}


def test_templates(spark):
    other = ITEM.replace("Tom", "Lena").replace("12", "7").replace("Mary", "Bob").replace("dollars", "euros")
    mixed = ITEM.replace("did Tom", "did Lena")  # one value, filled in two ways: most slots agree
    texts = ["Before. " + ITEM + "? After.", "so " + other + " yes", ITEM.lower(), ITEM.upper(), mixed, " ".join(ITEM.split()[::-1]), ITEM[:60], "Something else 12 apples entirely."]
    assert leak(spark, texts) == {(0, 0): False, (1, 0): True, (2, 0): False, (3, 0): False, (4, 0): True}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    test_templates(spark)


def test_numbers_alone_say_nothing(spark):
    assert leak(spark, ["1 2 3 4 5 6 7 8 9 10 11 12"] * 50, ("5 6 7 8 9 10 11 12 13",)) == {}


def test_odd_input(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short one"), (None, ITEM), (4, "the same text in two rows and a second line of it"), (4, None)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in d.leaks(odd, items).collect()} == {(4, 4)}
    assert d.leaks(none, items).count() == 0 and d.leaks(odd, items.where("false")).count() == 0
    kept = d.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == 7


PENS = "The shop on the corner sells 12 red pens and 12 blue pens to every child who comes in before noon and the owner then writes down what each of them paid"


def test_one_edit_of_a_repeated_value(spark):
    """Windows that stand word for word count, whatever other windows of the diagonal hold; equal values needn't be one parameter."""
    texts = ["So: " + PENS.replace("12 blue", "15 blue"), PENS.replace("12 red", "7 red").replace("12 blue", "8 blue"), PENS.replace("12", "7")]
    assert leak(spark, texts, (PENS,)) == {(0, 0): True, (1, 0): True, (2, 0): True}
    small = ("Alice has 3 apples and 3 pears in her small bag",)
    assert leak(spark, ["Bob has 4 apples and 4 pears in her small bag", "Bob has 4 apples and 5 pears in her small bag"], small) == {(0, 0): True, (1, 0): True}


def test_inconsistent_slots(spark):
    """A value that is filled in another way each time says that the template met by chance."""
    item = "we add 4 to 4 and then take 4 from 4 so that the 4 becomes what the other 4 was before"
    numbers = iter("123567")
    other = " ".join(next(numbers) if w == "4" else w for w in item.split())
    assert leak(spark, [other, item.replace("4", "9")], (item,)) == {(1, 0): True}


STOPS = set(".!?\n")


def template(text):
    """(token, placeholder or None) of each token that isn't a stop."""
    out, before = [], "."
    for t in d.TOKEN.findall(text or ""):
        if t not in STOPS:
            kind = "number" if t[0].isdigit() else "name" if t[0].isupper() and before not in STOPS else "unit" if t.lower() in d.UNITS and before[0].isdigit() else None
            out.append((t.lower(), kind))
        before = t
    return out


def brute(text, item, size=5, least=0.8, agree=0.5):
    """Whether the text holds the item, by comparing all places."""
    x, y = template(text), template(item)
    if not y:
        return False
    if len(y) < size:
        return any([a for a, _ in x[p : p + len(y)]] == [a for a, _ in y] for p in range(len(x) - len(y) + 1))
    windows = len(y) - size + 1
    told = [sum(k is None for _, k in y[i : i + size]) >= 3 for i in range(windows)]
    matched, verbatim = set(), 0
    for shift in range(-len(y), len(x)):
        hits = []
        for i in range(windows):
            if 0 <= i + shift and i + shift + size <= len(x):
                a, b = y[i : i + size], x[i + shift : i + shift + size]
                same = [u for u, _ in a] == [u for u, _ in b]
                typed = [k or u for u, k in a] == [k or u for u, k in b] and [k is None for _, k in a] == [k is None for _, k in b]
                if same or told[i] and typed:
                    hits.append((i, same, {(i + j, a[j][0], b[j][0]) for j in range(size) if a[j][1]}))
        held = Counter((u, v) for _, u, v in set().union(*[s for i, _, s in hits if told[i]]))
        best = {}
        for (u, _), n in held.items():
            best[u] = max(best.get(u, 0), n)
        split = len(held) > len(best) and sum(best.values()) < agree * sum(held.values())
        clash = {u for u, n in Counter(u for u, _ in held).items() if n > 1} if split else set()
        hits = [h for h in hits if h[1] or not clash & {u for _, u, _ in h[2]}]
        matched |= {i for i, _, _ in hits if told[i]}
        verbatim = max(verbatim, sum(same for _, same, _ in hits) / windows)
    return max(len(matched) / sum(told), verbatim) >= least if any(told) else verbatim >= 1


def test_templates_as_brute_force(spark):
    """Made-up items, and documents with their words, numbers and names changed in part."""
    rng = random.Random(3)
    plain, names = "the cat of a house ran to see how many red pens were in".split(), "Tom Ann Bob Lena".split()
    word = lambda: rng.choice([rng.choice(plain), rng.choice(plain), rng.choice(plain), rng.choice(names), str(rng.randrange(4))])
    items = [" ".join(word() for _ in range(rng.choice((3, 6, 9, 14, 20)))) for _ in range(40)]
    texts = []
    for _ in range(300):
        own = rng.choice(items).split()
        change = rng.choice((0, 0.2, 0.6, 1))
        own = [rng.choice(names) if w in names and rng.random() < change else str(rng.randrange(9)) if w.isdigit() and rng.random() < change else w for w in own]
        if rng.random() < 0.4:
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join([*[word() for _ in range(rng.randrange(5))], *own, *[word() for _ in range(rng.randrange(5))]]))
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if brute(t, x)}
    assert len(want) > 100 and set(leak(spark, texts, items)) == want


def test_recall_of_reparameterised_items(spark):
    """Benchmark texts with numbers, names and amounts put in, found with other ones; the texts without an item aren't.

    In every fourth text one of the slots is filled apart from its like, and in every fifth a word is left out.
    """
    rng = random.Random(11)
    number, name, unit = lambda: str(rng.randrange(1000)), lambda: rng.choice("Tom Ann Bob Lena Ida Max Eva Kim".split()), lambda: rng.choice("km kg hours days dollars".split())
    items, texts = [], []
    for n, r in enumerate(spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()):
        words = re.findall(r"\w+", r.text.lower())
        slots = {i: rng.choice((number, name, lambda: f"{number()} {unit()}")) for i in range(1, len(words)) if i % 4 == rng.randrange(4)}
        given = {i: f() for i, f in slots.items()}
        again = list(given)[-1]
        given[again] = given[next(i for i in slots if slots[i] is slots[again])]  # a value that comes twice
        new = {v: slots[i]() for i, v in given.items()}
        other = [new[given[i]] if i in given else w for i, w in enumerate(words)]
        if n % 4 == 0:
            other[again] = slots[again]()
        if n % 5 == 0:
            del other[rng.randrange(len(other))]
        items.append(" ".join(given.get(i, w) for i, w in enumerate(words)))
        texts.append(f"some words before . {' '.join(other)} . and some after")
    clean = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = leak(spark, [*texts, *clean], items)
    right = sum((i, i) in found for i in range(len(items)))
    print("found", right, "of", len(items), "and", len(found) - right, "others")
    assert right >= 0.9 * len(items) and not any(i >= len(items) for i, _ in found)

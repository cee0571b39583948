from collections import defaultdict

from boscage.llm import html_template as ht


def brute(pages):
    """The same by full occurrence vectors, host by host: {page: (template tokens, roles, slots, text)}."""
    by_host = defaultdict(list)
    for i, (url, page) in enumerate(pages):
        host = ht.host_of(url)
        if host is not None and page is not None:
            by_host[host].append(i)
    plans = {}
    for host, own in by_host.items():
        found = [ht.tokens(pages[i][1])[0].tolist() for i in own]
        vectors = defaultdict(lambda: [0] * len(own))
        for k, keys in enumerate(found):
            for key in keys:
                vectors[key][k] += 1
        classes = defaultdict(list)
        for key, v in vectors.items():
            support = sum(x > 0 for x in v)
            if support >= ht.LEAST_PAGES and support >= ht.SUPPORT * len(own):
                classes[tuple(v)].append(key)
        ordered = []
        for v, keys in classes.items():
            if len(keys) < ht.LEAST_SIZE:
                continue
            for part in (set(keys), {k for k in keys if not ht.is_word(k)}):
                if len(part) < ht.LEAST_SIZE:
                    continue
                orders = {ht.order_of([k for k in f if k in part], len(part)) for f in found if any(k in part for k in f)}
                if len(orders) == 1 and None not in orders:
                    ordered.append((sum(v), list(orders.pop())))
                    break
        ranked = [(n, keys) for n, (_, keys) in enumerate(sorted(ordered))]
        plan = ht.Plan(ranked)
        gaps = {}
        for f in found:
            for pair, (lo, hi) in ht.page_nesting(plan, f).items():
                was = gaps.get(pair, (lo, hi))
                gaps[pair] = min(was[0], lo), max(was[1], hi)
        plans[host] = ht.Plan(ht.nest(ranked, gaps))
    return {i: (None,) * 4 if p is None else ht.fill(plans.get(ht.host_of(u), ht.Plan([])), *ht.tokens(p)) for i, (u, p) in enumerate(pages)}


def page(k, items):
    rows = "".join(f"<li><span>item</span> name{k}x{j} <i>price</i> {j}{k} <hr></li>" for j in range(items))
    return f"<!DOCTYPE html><html><head><title>Shop - thing {k}</title><style>p{{}}</style></head><body><nav><a href='/{k}'>Home</a> <a>About us</a></nav><!-- {k} --><h1>thing {k}</h1><ul>{rows}</ul><p>Posted by author{k} &amp; co<br>on day{k}<footer>All rights reserved</footer></body></html>"


PAGES = (
    [(f"http://Shop.example/p/{k}", page(k, k % 4 + 1)) for k in range(8)]
    + [("http://shop.example/p/0", page(0, 1))]
    + [("https://two.example/a", page(1, 2)), ("https://two.example/b", page(2, 2))]
    + [(None, page(3, 1)), ("no host", page(4, 1)), ("http://shop.example/null", None), ("http://shop.example/odd", "<p>stray</b> text <unclosed")]
    + [(f"http://deep.example/{k}", "<div>" * 3000 + f"<b>in {k}</b>" + "word " * 20_000) for k in range(3)]
    + [("http://empty.example/", ""), ("http://empty.example/2", ""), ("http://empty.example/3", "")]
)


def frame(spark, pages):
    return spark.createDataFrame([(k, u, h, "x", "y") for k, (u, h) in enumerate(pages)], "page_id long, url string, html string, a string, b string").toDF("page_id", "url", "html", "host", "HTML")


def test_equals_full_vectors(spark):
    got = {r.page_id: r for r in ht.extract(frame(spark, PAGES).repartition(5)).collect()}
    want = brute(PAGES)
    assert len(got) == len(PAGES)
    for i, (known, roles, slots, text) in want.items():
        assert (got[i].template_tokens, got[i].slots, got[i].text) == (known, slots, text), i
    # roles name the same places, whatever the classes are called
    names = {}
    for i, (_, roles, _, _) in want.items():
        host = ht.host_of(PAGES[i][0])
        assert (roles is None) == (got[i].roles is None) and len(roles or ()) == len(got[i].roles or ())
        for mine, theirs in zip(roles or (), got[i].roles or ()):
            assert mine.partition(":")[2] == theirs.partition(":")[2] and names.setdefault((host, mine), theirs) == theirs
    assert len(set(names.values())) >= len({r for _, r in names}) > 3


def test_slots_of_a_shop(spark):
    got = {r.page_id: r for r in ht.extract(frame(spark, PAGES)).collect()}
    text = got[5].text
    for word in ("5", "name5x0", "name5x1", "author5", "day5"):
        assert word in text.replace("\n", " ").split(), word
    for word in ("Home", "About", "rights", "Posted", "Shop", "thing", "price", "item"):  # "thing" is in every title and heading
        assert word not in text.split(), word
    assert "Home" in got[10].text and "Home" in got[11].text  # too few pages; no host
    assert got[13].text is None and got[13].slots is None and got[18].text == "" and got[18].slots == []
    assert len(got[5].roles) == len(got[5].slots)


def test_empty_table(spark):
    assert ht.extract(frame(spark, PAGES).limit(0)).collect() == []


def test_tokens():
    keys, texts = ht.tokens("<p>a &lt;b <p>c<script>x < y</script><br/><!-- no --><b>d</p>")
    assert [t for t in texts if t and t != "\n"] == ["a", "<b", "c", "d"]
    assert keys[1] == keys[4] and keys[0] == ht.PAGE  # the second p isn't in the first
    assert all(ht.is_word(k) == (t not in ("", "\n")) for k, t in zip(keys, texts))
    assert ht.tokens("< 3 <")[1][1:] == ["<", "3", "<"]
    assert ht.tokens("<a title='x>y' b=\"<\">t")[1][-1] == "t"


def test_order_and_nesting():
    assert ht.order_of([1, 2, 3, 1, 2, 3], 3) == (1, 2, 3)
    assert ht.order_of([1, 2, 3, 2, 1, 3], 3) is None and ht.order_of([1, 2], 3) is None and ht.order_of([1, 1, 3], 3) is None
    plan = ht.Plan([(7, [1, 2, 3]), (8, [4, 5])])
    assert ht.page_nesting(plan, [1, 4, 5, 4, 5, 2, 3]) == {(0, 1): (1, 1)}
    assert ht.page_nesting(plan, [1, 4, 5, 2, 4, 5, 3]) == {(0, 1): (1, 2)}
    assert ht.page_nesting(plan, [1, 4, 2, 5, 3]) == {(0, 1): (-1, 1)}
    classes = [(7, [1, 2, 3]), (8, [4, 5])]
    assert ht.nest(classes, {(7, 8): (1, 1)}) == classes and ht.nest(classes, {(7, 8): (-1, 1)}) == classes[:1]


def test_query(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {r.page_id: r for r in ht.query(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, url, page in rows:
        words = [t for t in ht.tokens(page)[1] if t and t != "\n"]
        assert got[i].host == ht.host_of(url) and set(got[i].text.split()) <= set(words)


def test_brackets_in_quotes():
    words = lambda page: [t for t in ht.tokens(page)[1] if t and t != "\n"]
    assert words("<a title='1 < 2 > 0' b=\"<i>\">t</a> u") == ["t", "u"]
    assert words('<a x="<b>" y=\'<c\' >t<d e="<<<"/>u') == ["t", "u"]
    assert words('<p class="a>text <b class="x">y') == ["text", "y"]  # a stray quote ends with its tag
    assert words("<a b='never closed>t <i>u") == ["t", "u"]
    long = "<a b='" + "<x " * 50_000 + "'>t"
    assert words(long) == ["t"]


def test_three_layouts_on_one_host(spark):
    """A layout that only a third of a host's pages have is a template all the same."""
    layouts = [
        lambda k: f"<html><body><div><h2>Article</h2><em>written by</em></div><p>story{k} text{k}</p><footer>Imprint of articles</footer></body></html>",
        lambda k: f"<html><body><table><tr><th>Product</th><th>Costs</th></tr><tr><td>thing{k}</td><td>{k}eur</td></tr></table><aside>Add to basket</aside></body></html>",
        lambda k: f"<html><body><ol><li>Overview of all</li><li>entry{k}</li></ol><section><b>Next page</b> <i>Last page</i></section></body></html>",
    ]
    pages = [(f"http://mixed.example/{k}", layouts[k % 3](k)) for k in range(30)]
    got = {r.page_id: set(r.text.split()) for r in ht.extract(frame(spark, pages)).collect()}
    assert got[0] == {"story0", "text0"} and got[4] == {"thing4", "4eur"} and got[8] == {"entry8"}

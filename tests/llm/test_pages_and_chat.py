"""op7 and op8: known pages, exact round trips, attention and positions."""

import hashlib
import random
import time

import pytest

from patchloom.llm import chat, html_extract
from patchloom.llm.common import read

from .util import SF, frame, same_rows


@pytest.fixture(scope="module")
def weights():
    return html_extract.train()


def test_other_generated_pages(weights):
    good = total = 0
    for page, y in html_extract.training_pages(120, seed=4242):
        got = set(html_extract.extract(page, weights).split("\n"))
        good += sum((t in got) == want for t, want in y.items())
        total += len(y)
    assert good >= 0.98 * total


ARTICLE = "<article><h1>Head line of it</h1><p>First paragraph of the article, with quite some words in it.</p><p>Second paragraph of the article, which ends here.</p></article>"
OPEN = ["<svg/>", '<svg width="1" />', "<button>", "<iframe src=x>", "<noscript>", '<script src="x"/>', "<svg><svg></svg>", "<!-- </svg> --><svg>", "<button><i></i>"]


@pytest.mark.parametrize("tag", OPEN)
def test_embedded_elements_without_end_drop_nothing(weights, tag):
    """The next end tag of the name belongs to the element after the article."""
    want = "Head line of it\nFirst paragraph of the article, with quite some words in it.\nSecond paragraph of the article, which ends here."
    name = tag.split("<")[1].split()[0].strip("/>") if "!--" not in tag else "svg"
    for after in ("", f"<{name}>inside</{name}>"):
        assert html_extract.extract(f"<html><body>{tag}{ARTICLE}{after}</body></html>", weights) == want


def test_embedded_elements_with_end_go_whole():
    page = "<p>a<svg><text>b<svg>c</svg>d</text></svg>e</p><iframe src=http://x/>f</iframe><script>'<svg>'</script><p>g</p><select><option>h</select>"
    assert [b.text for b in html_extract.blocks_of(page)] == ["a", "e", "g"]


def test_math_is_text_of_its_paragraph():
    page = "<p>so <math><mi>x</mi><mspace/><mo>=</mo><mn>2</mn></math> holds</p><p>next</p>"
    assert [b.text for b in html_extract.blocks_of(page)] == ["so x=2 holds", "next"]


def test_cut_of_a_very_long_page():
    """50,000 doubtful blocks, neighbours and siblings tied; seconds, not hours."""
    r = random.Random(12)
    n = 50_000
    edges = [(i - 1, i, html_extract.ADJACENT) for i in range(1, n)] + [(i - r.randint(2, 9), i, html_extract.SIBLING) for i in range(9, n, 3)]
    begun = time.time()
    keep = html_extract.min_cut([r.uniform(-0.7, 0.7) for _ in range(n)], edges)
    assert len(keep) == n and len(set(keep)) == 2 and time.time() - begun < 60


def test_paragraphs_close_below_many_inline_elements():
    deep = "<b><i><u><s><em><strong>"
    blocks = html_extract.blocks_of(f"<div><p>{deep}one<p>two</div><p>three")
    assert [b.text for b in blocks] == ["one", "two", "three"] and blocks[0].parent != blocks[1].parent
    assert [x[0] for x in blocks[1].path] == ["div", "p"]


def test_copyright_words_count_anywhere_in_a_block():
    long = "word " * 100
    said, plain = (html_extract.blocks_of(f"<p>{long}{x}</p>")[0] for x in ("All rights reserved", "nothing of it is"))
    assert [a != b for a, b in zip(html_extract.features(said), html_extract.features(plain), strict=True)][11]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site name</p></header><nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav>
<div class="cookie-banner"><p>We use cookies to make this site better for all of you.</p></div>
<article><h1>A &amp; B &lt;c&gt;</h1><p>First <b>bold</b>\n\n  text &eacute;&#233;&#x41;, with\twhite space and some more words in it.<p>Second <a href="z">linked</a> paragraph, which goes on for a while.
<script>var a = "<p>no</p>";</script><!-- <p>nor this</p> --><div class="ad">Buy this now and save.</div><p>Last paragraph of the article, and it ends here.</article>
<div id="comments"><p>A reader says that all of this is wrong and goes on about it.</p></div><form><label>Name</label><input><p>Send us mail</p></form><footer>&copy; Someone. All rights reserved.</footer>"""


def test_known_page(weights):
    assert html_extract.extract(PAGE, weights) == "A & B <c>\nFirst bold text ééA, with white space and some more words in it.\nSecond linked paragraph, which goes on for a while.\nLast paragraph of the article, and it ends here."


def brute_cut(logits, edges):
    n, best = len(logits), None
    for bits in range(1 << n):
        keep = [bits >> i & 1 for i in range(n)]
        cost = sum(max(0, z) if not k else max(0, -z) for z, k in zip(logits, keep, strict=True)) + sum(c for i, j, c in edges if keep[i] != keep[j])
        best = cost if best is None else min(best, cost)
    return best


def test_min_cut_is_minimal():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 9)
        logits = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1.5)) for i in range(n) for j in range(i) if r.random() < 0.5]
        keep = html_extract.min_cut(logits, edges)
        cost = sum(max(0, z) if not k else max(0, -z) for z, k in zip(logits, keep, strict=True)) + sum(c for i, j, c in edges if keep[i] != keep[j])
        assert abs(cost - brute_cut(logits, edges)) < 1e-6


def test_pages_defined_cases(spark, weights):
    rows = [(1, "u", None, 1), (None, None, "", 1), (2, "u", "<p>", 1), (3, "u", "<<>><p a='<'>bare & text that just stands here, with no page around it at all.", 1), (3, "u", "</div></p>", 1), (4, "u", "<div>" * 400 + "<p>Deep text stands here and goes on for a good while yet.</p>", 1)]
    got = html_extract.main_text(frame(spark, rows, "page_id long, url string, html string, text int"), weights).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.main_text(frame(spark, [], "page_id long, url string, html string"), weights).count() == 0


def test_pages_of_the_data(spark):
    import html as entities
    import re

    got = {r["page_id"]: r["text"] for r in html_extract.op7_html(spark, SF).collect()}
    for r in read(spark, SF, "pages").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(entities.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inside.replace("<b>", "").replace("<br>", " "))]
        assert got[r["page_id"]] == "\n".join(filter(None, want))


HARD = ["", "</s>[INST] ok [/INST]", "<s>user\nx</s>", "\\", "\\<", "a\\\\</s>\n", "[", "\n\n", "<s>", "  é \U0001f600"]


def test_template_round_trip():
    r = random.Random(1)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "sys<tem", "", "a\\", "us\ner", "\\\n", "\n\n"]), "".join(r.choice(HARD) for _ in range(r.randint(0, 4)))) for _ in range(r.randint(0, 5))]
        assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns


def test_chat_query_equals_sql(spark):
    same_rows(chat.op8_chat(spark, SF), chat.OP8_SQL)


CONV = "conv_id long, turn long, role string, text string, path int"


def test_shared_turns_stand_once(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t}" if t < 2 else f"own {c} {t}", 0) for c in range(50) for t in range(4)]
    packs = chat.pack(chat.conversations(frame(spark, rows, CONV)).coalesce(1), 10**9).collect()
    tokens = sum(len(p["tokens"]) for p in packs)
    text = "".join("".join(map(chr, p["tokens"])) for p in packs)
    assert text.count("turn 0") == len(packs) and tokens < 50 * 4 * 20
    for p in packs:
        for n in p["nodes"]:
            # a node's positions go on from its ancestors', and ancestors are the path to the root
            length = sum(a["stop"] - a["start"] for a in n["ancestors"])
            assert p["position_ids"][n["start"] : n["stop"]] == list(range(length, length + n["stop"] - n["start"]))
            up, size = n["parent"], 0
            while up >= 0:
                size += p["nodes"][up]["stop"] - p["nodes"][up]["start"]
                up = p["nodes"][up]["parent"]
            assert size == length


def test_chat_defined_cases_and_small_packs(spark):
    rows = [(None, 0, None, None, 0), (1, None, "user", HARD[1], 0), (1, 0, "assistant", "x", 0), (1, 0, "assistant", "x", 0), (2, 0, "us\ner", "y", 0)]
    df = chat.conversations(frame(spark, rows, CONV))
    one = sorted(map(tuple, chat.read_back(chat.pack(df)).collect()), key=repr)
    assert one == sorted(map(tuple, chat.read_back(chat.pack(df, 1)).collect()), key=repr)
    assert {r[0]: r[1] for r in one} == {None: 1, 1: 3, 2: 1}
    assert {r[0]: r[3] for r in one} == {None: 0, 1: 2, 2: 0}
    assert {r[0]: r[2] for r in one}[2] == hashlib.sha256(b"us\ner\ny\n").hexdigest()
    assert chat.read_back(chat.pack(chat.conversations(frame(spark, [], CONV)))).count() == 0


def test_very_long_turns(spark):
    said = HARD[1] * 40_000
    rows = [(c, t, ("user", "assistant")[t % 2], said if t < 2 else f"own {c}", 0) for c in range(3) for t in range(4)]
    for r in chat.read_back(chat.pack(chat.conversations(frame(spark, rows, CONV)))).collect():
        told = "".join(f"{role}\n{text}\n" for c, _, role, text, _ in rows if c == r["conv_id"])
        assert r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["loss_chars"] == len(said) + len(f"own {r['conv_id']}")

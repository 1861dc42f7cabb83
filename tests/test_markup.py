from quarry.functions.markup import article_sections, card_sections, clause_sections, to_markdown


def test_rendering():
    html = (
        '<p>A <b>bold</b> <em>word</em> <code>x</code><br>line &amp; <a href="/p">rel</a> <a href="{e}">lab</a> <a href="https://x.y"></a></p>'
        '<img alt=" pic "><img><pre>  a\n   b</pre><ul><li>one</li><li>two</li></ul><h2>Head</h2><table><tr><th>k</th><td>v</td></tr></table><script>no</script>'
    )
    out = to_markdown(html, "https://b")
    assert out == (
        "A **bold** _word_ `x`\nline & [rel](https://b/p) lab https://x.y\n\n[image: pic]\n\n```\na\nb\n```\n\n- one\n- two\n\n## Head\n\nk | v |"
    )


def test_unclosed_and_stray_tags():
    assert to_markdown("<p>a<p>b</div><b>c") == "a\nb**c**"
    assert to_markdown("") == ""


def test_sections_and_subsections():
    html = "<section><h2>H</h2><p>intro</p><h3>S1</h3><p>one</p><h3>S2</h3></section><section><p>plain</p></section>"
    assert article_sections(html) == [("H", None, "intro"), ("H", "S1", "one"), ("H", "S2", ""), (None, None, "plain")]


def test_sections_by_heading():
    assert article_sections("<p>pre</p><h2>A</h2><p>a</p><h2>B</h2>") == [(None, None, "pre"), ("A", None, "a")]


def test_cards():
    html = '<collapsiblecard><span class="subtitle">3</span><div class="title">Be kind<br>x</div><div class="body"><p>Text</p></div></collapsiblecard><collapsiblecard><span class="subtitle">4</span></collapsiblecard>'
    assert card_sections(html) == [("3", "Be kind", "Text")]


def test_clauses():
    src = (
        '<div class="preamble"><p>By using this you agree.</p></div>'
        '<HashLinkTarget id="1"><h2>General</h2><ul class="custom_list" style="--prefix: \'A\'"><li>first clause that is long enough to stay</li><li>second clause</li></ul>'
        '<HashLinkTarget id="2"><h2>More</h2><div><h3>Group</h3><ul class="custom_list" style="--prefix: \'1.\'; --suffix: \'\'"><li>nested clause that is long enough to stay in</li></ul><h3>Tiny</h3><p>x</p></div>'
    )
    got = clause_sections(src)
    assert got == [
        ("0", "Preamble", None, "By using this you agree."),
        ("1", "General", None, "A1) first clause that is long enough to stay\n\nA2) second clause"),
        ("2", "More", "Group", "1.1 nested clause that is long enough to stay in"),
    ]


def test_deep_nesting():
    assert to_markdown("<p>x" * 5000).replace("\n", "") == "x" * 5000

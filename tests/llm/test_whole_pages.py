"""Pages whose names only look like menus and comments, and elements that are never closed."""

import pytest

from colloquy.llm import extraction as x

SENTENCE = "one two three four five six seven eight nine ten eleven twelve."
OTHER = "some other words that also belong to what the page has to say."


class Weights(dict):
    """Words score, tags cost little."""

    def get(self, feature):
        return 0.9 if feature[0] in "wlh" else -0.1


@pytest.mark.parametrize("open_, close", [
    ("<div class='layout has-sidebar'>", "</div>"), ("<div id='post-with-comments'>", "</div>"), ("<div class=widget>", "</div>"),
    ("<div><section class='share'>", "</section></div>"),
])
def test_wrappers_keep_their_text(open_, close):
    assert x.main_text(f"<body><nav>menu</nav>{open_}<p>{SENTENCE}</p>{close}</body>", Weights()) == SENTENCE


@pytest.mark.parametrize("part", [
    "<section id='related-work'>{}</section>", "<p class='notice-period'>{}</p>", "<p>a <span class='share'>{}</span></p>",
    "<figure><figcaption>{}</figcaption></figure>", "<p><math><mi>{}</mi></math></p>", "<object><p>{}</p></object>", "<map><p>{}</p></map>",
])
def test_parts_of_an_article_stay(part):
    page = f"<article><p>{SENTENCE}</p>{part.format('of its own')}<p>{OTHER}</p></article>"
    assert "of its own" in x.main_text(page, Weights())


@pytest.mark.parametrize("skipped", ["<aside>side", "<div class=comments>side", "<form><div>side", "<ul><li class=menu>side<li></ul>"])
def test_unclosed_skips_end_with_what_holds_them(skipped):
    page = f"<article><p>{SENTENCE}</p>{skipped}</article><p>{OTHER}</p>"
    assert x.main_text(page, Weights()) == f"{SENTENCE} {OTHER}"


@pytest.mark.parametrize("part", ["<div class='advert box'>side</div>", "<div id=nav-menu>side</div>", "<aside><script>'</aside>'</script>side</aside>", "<aside><div>side</div></aside>"])
def test_what_is_named_so_goes(part):
    assert x.main_text(f"<article><p>{SENTENCE}</p>{part}<p>{OTHER}</p></article>", Weights()) == f"{SENTENCE} {OTHER}"


def test_nested_blocks_are_linear():
    for page in ("<div class=nav>" * 50_000 + "a b", "<ul><li>" * 50_000, "<li><div class=ad>" * 50_000, "<div>" * 50_000 + "<li></li>" * 50_000, "<svg><style/>" * 50_000):
        assert len(x.main_text(page, Weights())) <= len(page)

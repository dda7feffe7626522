"""A class or id alone never empties a page; what it names is still dropped."""

import pytest

from linearspark.llm.extract import main_text

STORY = [f"Paragraph {i} of the story, with enough words to be dense text." for i in range(5)]
CONTENT = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in STORY)
TEXT = "\n".join(["Title", *STORY])


@pytest.mark.parametrize("name", ["layout has-sidebar", "page with-nav", "post tag-news tags-2 share-on", "related-work", "no-ads",
                                  "social-science", "story comments-open", "widget", "site-modal"])
def test_wrappers_keep_their_text(name):
    for tag in ("div", "section", "article"):
        page = f'<html><body><nav>Menu</nav><{tag} class="{name}">{CONTENT}</{tag}><footer>Foot</footer></body></html>'
        assert main_text(page) == TEXT
        assert main_text(page.replace("class=", "id=")) == TEXT


def test_other_names_within_the_article_stay():
    page = f'<html><body><article>{CONTENT}<div class="notice-board"><p>Posted on the notice board in town.</p></div></article></body></html>'
    assert main_text(page) == TEXT + "\nPosted on the notice board in town."


@pytest.mark.parametrize("name", ["cookie-notice", "ad", "site-footer", "ad-box-2", "newsletter signup", "sidebar widget", "comments"])
def test_noise_goes_inside_and_outside(name):
    noise = f'<div class="{name}"><p>Something else to read here, or to buy.</p></div>'
    assert main_text(f"<html><body>{noise}<article>{CONTENT}{noise}</article>{noise}</body></html>") == TEXT
    assert main_text(f"<html><body><div>{noise}<div>{CONTENT}{noise}</div></div></body></html>") == TEXT


def test_header_of_main_stays():
    page = f"<html><body><header>Site</header><main><header><h1>Title</h1></header>{CONTENT[14:]}</main></body></html>"
    assert main_text(page) == TEXT


def test_several_templates():
    table = f"<html><body><table><tr><td><a href=/>Home</a> <a href=/b>More</a></td><td>{CONTENT}</td></tr></table></body></html>"
    bare = f"<html><body><ul><li><a href=/>Home</a></li></ul>{CONTENT}<ul><li><a href=/x>Next</a></li></ul></body></html>"
    nested = f"<html><body><div id=page><div class='menu'><a href=/>Home</a></div><div><div class=entry>{CONTENT}</div></div></div></body></html>"
    for page in (table, nested, bare):
        got = main_text(page).split("\n")
        assert [x for x in got if x in STORY] == STORY

"""Pages on which tags or class words alone give the wrong text."""

from paceline.llm.html_text import main_text

BODY = "<div class=story><div class=x><p>" + "This is the body, with commas, and stops. " * 8 + "<p>Short one.</div><div class=x><p>" + "More of it, as it goes on, at length. " * 9 + "</div></div>"
CARDS = "".join(f"<article class=card><h3>Card {i}</h3><p>Teaser, read on.</p></article>" for i in range(4))
COMMENTS = BODY.replace("<p>", "<p>" + "Comment, here. " * 4)


def lines(page):
    return [x[:12] for x in main_text(page).split("\n")]


def test_body_beside_teasers():
    want = ["This is the ", "Short one.", "More of it, "]
    assert lines(f"<body>{BODY}<section>{CARDS}</section></body>") == want
    assert lines(f"<main>{CARDS}{BODY}</main>") == want


def test_class_words_on_the_whole_page():
    want = ["This is the ", "Short one.", "More of it, "]
    assert lines(f"<body class='home has-sidebar'>{BODY}</body>") == want
    assert lines(f"<body><div id=page class='share search'>{BODY}</div>{CARDS}</body>") == want


def test_class_words_still_take_out_parts():
    assert lines(f"<body><article><header><h1>Title</h1></header><div>{BODY}</div></article><div class=comments>{COMMENTS}</div></body>") == ["Title", "This is the ", "Short one.", "More of it, "]
    assert lines(f"<body><div class=ad>{'Buy, buy. ' * 30}</div><article><h1>Title</h1><p>Few words, here.</p></article></body>") == ["Title", "Few words, h"]

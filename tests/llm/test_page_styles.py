"""Pages written by hand in styles that the training generator doesn't make: (html, main text)."""

import pytest

from lacuna.llm import page_crf

A = "The council met on Tuesday evening to discuss the new bridge, and most members agreed that it should be built soon."
B = "Work begins in spring. The mayor said that the costs are covered by the state, as was promised last year."
C = "Residents had asked for it since the old bridge was closed to lorries, which now have to drive round by the next town."
H = "Town to build a new bridge"

PAGES = {
    "plain divs": (f"<html><body><div><div><a href=/>Home</a> <a href=/n>News</a></div><div><div>{A}</div><div>{B}</div></div><div>Imprint | Contact</div></div></body></html>", f"{A}\n{B}"),
    "headline in the article's header": (f"<body><nav><a href=/>Home</a></nav><article><header><h1>{H}</h1></header><p>{A}</p><p>{B}</p></article><footer>All rights reserved</footer>", f"{H}\n{A}\n{B}"),
    "share links and a comment service": (f"<body><article><h1>{H}</h1><p>{A}</p><p>{C}</p><div class=social><a href=x>Share on Facebook</a></div></article><div id=disqus_thread><p>I don't think that this is a good idea at all.</p></div>", f"{H}\n{A}\n{C}"),
    "old table layout": (f"<html><body><table><tr><td><a href=1>Start</a><br><a href=2>Links</a></td><td><p>{A}<p>{B}<p>{C}</td></tr></table></body></html>", f"{A}\n{B}\n{C}"),
    "bare paragraphs": (f"<title>x</title><p>{A}</p><p>{B}</p>", f"{A}\n{B}"),
    "main of sections": (f"<body><header class=top><a href=/>The Herald</a></header><main><section><h2>{H}</h2><p>{A}</p></section><section><p>{C}</p></section></main><footer><p>&copy; The Herald</p></footer>", f"{H}\n{A}\n{C}"),
    "list in the text": (f"<body><div class=post-content><p>{A}</p><ul><li>The first lane opens in May.</li><li>The second one follows in June.</li></ul><p>{B}</p></div><div class=sidebar><ul><li><a href=1>Older posts</a></li></ul></div>", f"{A}\nThe first lane opens in May.\nThe second one follows in June.\n{B}"),
    "cookie dialogue first": (f"<body><div role=dialog class=cookie-consent><p>We use cookies to improve this site. Please accept them.</p><button>Accept</button></div><article><p>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
    "newsletter between paragraphs": (f"<body><article><p>{A}</p><form class=newsletter><label>Your address</label><input><button>Subscribe</button></form><p>{C}</p></article>", f"{A}\n{C}"),
    "related links after": (f"<body><article><p>{A}</p><p>{B}</p></article><div class=related><h3>Read more</h3><ul><li><a href=1>Bridge closed</a></li><li><a href=2>Lorries rerouted</a></li></ul></div>", f"{A}\n{B}"),
    "thread of answers": (f"<body><div class=entry><h1>{H}</h1><p>{A}</p><p>{B}</p></div><ol class=commentlist><li>Great news, at last!</li><li>They should have asked us first.</li></ol>", f"{H}\n{A}\n{B}"),
    "scripts and references": (f"<body><script>var a = '<p>no</p>';</script><article><p>Caf&eacute; &amp; bar:   open\n again.</p><p>{A}</p></article><style>p {{}}</style>", f"Café & bar: open again.\n{A}"),
    "empty frame": ("<html><head><title>t</title></head><body><nav><a href=1>Home</a><a href=2>Shop</a></nav></body></html>", ""),
}


@pytest.mark.parametrize("style", PAGES)
def test_style(style):
    page, text = PAGES[style]
    assert page_crf.main_text(page, page_crf.trained()) == text

"""Pages labelled by hand, for the extraction model: ``data-keep`` 1 or 0 holds for an element and
what is below it until another label."""

_A = "The river rose again last night. Farmers near the bridge had moved their animals up the hill, and most houses stayed dry. "
_B = "Nobody was hurt, said the mayor; the new wall, built three years ago, held back the water for six hours. "
_C = "Short note."
_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
_FOOT = "<footer>&copy; 2020 The Valley Post. All about the valley, since 1920. <a href='/imprint'>Imprint</a></footer>"

PAGES = [
    # article element, advert, navigation, footer
    f'<html><head><title>River</title></head><body>{_NAV}<div class="ad">Buy two pairs of boots and pay for one. Only today.</div>'
    f'<article data-keep="1"><h1>The river</h1><p>{_A}</p><p><b>{_B}</b></p><p>{_C}</p></article>{_FOOT}</body></html>',
    f'<html><body>{_NAV}<div class="ad">{_A}</div><article data-keep="1"><h1>Water, again and again</h1><p><b>{_A}{_B}<br><p>{_B}</p><p>{_C}</p>'
    f"</article><footer>{_B}</footer>",
    # short articles
    f'<html><body>{_NAV}<div class="advert">Sale. Now.</div><article data-keep="1"><h1>Note</h1><p>{_C}</p></article><footer>{_A}</footer></body></html>',
    f'<html><body><article data-keep="1"><h1>A</h1><p>Dry.</p></article><footer>The end of it.</footer></body></html>',
    # a page without article element, with header, sidebar and newsletter form
    f'<html><body><header><h1>The Valley Post</h1><p>News from the valley, every day of the week.</p></header><div id="content" data-keep="1"><h2>River</h2>'
    f'<p>{_A}</p><ul><li>Bridge closed until the weekend.</li><li>School open as always.</li></ul><p>{_B}</p></div>'
    f'<aside class="sidebar"><h3>Most read</h3><p>{_B}</p><ul><li><a href="/x">Ten walks in the hills</a></li></ul></aside>'
    f'<form action="/s"><label>Your mail</label><input name="m"><p>Sign up and get our letter each week.</p><button>Sign up</button></form>{_FOOT}</body></html>',
    # notices, comments, share bar and related links inside the article
    f'<html><body><div class="cookie-notice"><p>We use cookies to make this site better. By reading on, you agree.</p><button>OK</button></div>{_NAV}'
    f'<main data-keep="1"><article><h1>River</h1><p>{_A}</p><div class="share" data-keep="0"><a href="#">Share</a> <a href="#">Mail</a></div><p>{_B}</p>'
    f'<blockquote><p>{_B}</p></blockquote><div class="related" data-keep="0"><h3>Related</h3><p>{_A}</p><a href="/y">The old wall</a></div>'
    f'<aside data-keep="0"><p>{_B}</p></aside></article>'
    f'<section id="comments" class="comments" data-keep="0"><h3>3 comments</h3><div class="comment"><p>{_A}</p></div><div class="comment"><p>{_B}</p></div>'
    f"<form><textarea>Say something</textarea><button>Send</button></form></section></main>{_FOOT}</body></html>",
    # comments and a notice as blocks of the article, links within its text, a table
    f'<html><body>{_NAV}<article data-keep="1"><div class="notice" data-keep="0"><p>{_A}</p></div><h1>River</h1><p>{_A}<a href="/b">The bridge</a> is <em>closed</em>. {_B}</p>'
    f"<table><tr><th>Place</th><th>Level</th></tr><tr><td>Bridge</td><td>3 m</td></tr></table><pre>12.30 3 m</pre>"
    f'<div class="user-comments" data-keep="0"><p>{_B}{_A}</p><p>{_A}</p></div><div class="ad-banner" data-keep="0"><p>{_B}</p></div><p>{_C}</p></article>'
    f'<div id="sidebar"><p>{_A}</p><p>{_B}</p></div><div class="site-footer"><p>{_B}</p></div></body></html>',
    # plain blocks
    f'<html><body><div id="header"><a href="/">Home</a> <a href="/n">News</a></div><div class="post-body" data-keep="1"><p>{_A}</p><p>{_B}</p><div><p>{_A}</p></div></div>'
    f'<div class="popup"><p>{_A}</p></div><div class="menu"><a href="/1">One</a> <a href="/2">Two</a></div></body></html>',
    f'<html><body><div><div><p data-keep="1">{_A}</p><p data-keep="1">{_B}</p><p data-keep="1">{_C}</p></div></div><div class="breadcrumbs"><a href="/">Home</a></div></body></html>',
    f'<html><body><section class="article-text" data-keep="1"><header><h1>River</h1></header><p>{_A}</p><figure><img src="r.png"><figcaption>The river at noon.</figcaption></figure><p>{_B}</p>'
    f'<footer data-keep="0"><p>Written by the staff.</p></footer></section><section class="newsletter"><p>{_A}</p></section></body></html>',
    f'<html><body><article data-keep="1"><header><h1>River</h1></header><p>{_C}</p><p>{_A}</p><footer data-keep="0">By the staff. All rights kept.</footer></article>'
    f'<div class="comments"><p>{_A}{_B}</p><p>{_C}</p></div></body></html>',
    f'<html><body>{_NAV}<article data-keep="1"><p>{_C}</p><nav data-keep="0"><a href="/2">Next page</a></nav><footer data-keep="0"><p>{_B}</p></footer></article></body></html>',
    # nothing to keep
    f"<html><body>{_NAV}<form><p>Name and password, please.</p><input><button>Log in</button></form>{_FOOT}</body></html>",
    f'<html><body><div class="error-notice"><p>Not found.</p></div>{_NAV}</body></html>',
]

"""Hand-written pages of many layouts with their main text: none was made by the generator that the labeller learns from."""

PAGES = {
    "blog": (
        """<!DOCTYPE html><html><head><title>Baking at home</title><meta charset="utf-8"></head><body class="single">
<div id="masthead" class="site-header"><a href="/">Crumbs and Crusts</a><p class="tagline">A diary of bread</p></div>
<nav class="primary-menu"><ul><li><a href="/">Home</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/about">About me</a></li></ul></nav>
<div id="content"><div class="post"><h1 class="entry-title">My first sourdough</h1><div class="entry-content">
<p>Last winter I finally decided to bake a real sourdough loaf. It took me <em>three weeks</em> to get the starter going.</p>
<p>The first loaf was as flat as a plate, but the smell in the kitchen made up for it.</p>
<h2>What I learned</h2><ul><li>Patience matters more than flour.</li><li>A hot oven is half the work.</li></ul>
<p>Next week I will try a rye loaf with caraway &amp; honey.</p></div>
<div class="sharedaddy share-buttons"><a href="#">Facebook</a> <a href="#">Twitter</a></div></div>
<div id="comments" class="comments-area"><h3>2 responses</h3><ol class="comment-list"><li class="comment"><b>Ann</b><p>What a lovely story, I had the same trouble with mine!</p><a href="#">Reply</a></li>
<li class="comment"><b>Bob</b><p>Try bread flour with more protein.</p><a href="#">Reply</a></li></ol></div></div>
<div class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href="/a">Choosing an oven</a></li><li><a href="/b">Salt or no salt</a></li></ul></div>
<div class="site-footer">Copyright 2021 Crumbs and Crusts. Proudly hosted at home.</div></body></html>""",
        [
            "My first sourdough",
            "Last winter I finally decided to bake a real sourdough loaf. It took me three weeks to get the starter going.",
            "The first loaf was as flat as a plate, but the smell in the kitchen made up for it.",
            "What I learned",
            "Patience matters more than flour.",
            "A hot oven is half the work.",
            "Next week I will try a rye loaf with caraway & honey.",
        ],
    ),
    "newspaper": (
        """<html><body><div class="cookie-consent" role="dialog"><p>We use cookies to improve your experience on our site.</p><button>Accept all</button></div>
<header class="page-header"><a href="/">The Daily Harbour</a><nav><a href="/world">World</a><a href="/sport">Sport</a><a href="/culture">Culture</a></nav></header>
<main><article><h1>Ferry service returns to the northern islands</h1>
<p>The ferry that links the northern islands to the mainland will sail again from Monday, the harbour authority said on Friday.</p>
<aside class="advertisement"><p>Book your summer cruise today and save up to 40 percent!</p></aside>
<p>The service was halted in March after a storm damaged the pier. Repairs cost about two million euros and took longer than planned.</p>
<figure><img src="p.jpg"><figcaption>The pier on the day after the storm.</figcaption></figure>
<p>&ldquo;We are relieved,&rdquo; said the mayor of the largest island, where shops had run short of fresh food.</p></article></main>
<section class="related-stories"><h2>More stories</h2><ul><li><a href="/1">Storm season starts early</a></li><li><a href="/2">A new bridge is planned</a></li></ul></section>
<footer><p>&copy; 2023 The Daily Harbour. All rights reserved.</p><a href="/privacy">Privacy</a></footer></body></html>""",
        [
            "Ferry service returns to the northern islands",
            "The ferry that links the northern islands to the mainland will sail again from Monday, the harbour authority said on Friday.",
            "The service was halted in March after a storm damaged the pier. Repairs cost about two million euros and took longer than planned.",
            "The pier on the day after the storm.",
            "“We are relieved,” said the mayor of the largest island, where shops had run short of fresh food.",
        ],
    ),
    "table layout": (
        """<HTML><HEAD><TITLE>Old clocks</TITLE></HEAD><BODY BGCOLOR="#FFFFFF"><TABLE WIDTH="100%"><TR><TD WIDTH="150"><A HREF="index.htm">Home</A><BR><A HREF="clocks.htm">Clocks</A><BR><A HREF="links.htm">Links</A></TD>
<TD><H1>Repairing old clocks</H1><P>The oldest clock in my workshop dates from 1780. When it came to me, the spring was broken and the wheels were full of dust.
<P>First the movement is taken out of its case. Every part is washed in warm water and dried with a soft cloth.
<P>Then the teeth of the wheels are checked one by one. A worn tooth has to be filed and filled with brass.</TD></TR></TABLE>
<HR><FONT SIZE="1">Last changed 3 May 1999. Mail to the webmaster.</FONT></BODY></HTML>""",
        [
            "Repairing old clocks",
            "The oldest clock in my workshop dates from 1780. When it came to me, the spring was broken and the wheels were full of dust.",
            "First the movement is taken out of its case. Every part is washed in warm water and dried with a soft cloth.",
            "Then the teeth of the wheels are checked one by one. A worn tooth has to be filed and filled with brass.",
        ],
    ),
    "divs without classes": (
        """<html><body><div><div><a href="/">Start</a> | <a href="/shop">Shop</a> | <a href="/news">News</a> | <a href="/contact">Contact</a></div>
<div><div><h2>How bees find their way</h2></div><div>A bee that leaves the hive for the first time flies in wide loops. It learns what the hive looks like from all sides.</div>
<div>Later it steers by the sun. Because the sun moves, the bee has to know the time of day as well, and it does.</div>
<div>On cloudy days it reads the pattern of polarised light in a patch of blue sky.</div></div>
<div><a href="/imprint">Imprint</a> <a href="/terms">Terms</a></div></div></body></html>""",
        [
            "How bees find their way",
            "A bee that leaves the hive for the first time flies in wide loops. It learns what the hive looks like from all sides.",
            "Later it steers by the sun. Because the sun moves, the bee has to know the time of day as well, and it does.",
            "On cloudy days it reads the pattern of polarised light in a patch of blue sky.",
        ],
    ),
    "documentation": (
        """<html><body><div class="topbar"><a href="/">tinyqueue</a><form class="search"><input name="q"><button>Search</button></form></div>
<div class="sidebar-nav"><ul><li><a href="#install">Install</a></li><li><a href="#usage">Usage</a></li><li><a href="#api">API reference</a></li></ul></div>
<div class="markdown-body"><h1>Getting started</h1><p>tinyqueue is a small job queue that keeps its state in a single file.</p><h2>Install</h2><pre><code>make install</code></pre>
<p>The program needs no other libraries. Run the tests before you use it in earnest.</p><h2>Usage</h2><ol><li>Open a queue with a path.</li><li>Push a job, which may be any string.</li></ol>
<table><tr><th>Option</th><th>Meaning</th></tr><tr><td>path</td><td>where the file lies</td></tr></table></div>
<div class="pager"><a href="/prev">Previous</a><a href="/next">Next</a></div><footer>Built with care. <a href="/license">License</a></footer></body></html>""",
        [
            "Getting started",
            "tinyqueue is a small job queue that keeps its state in a single file.",
            "Install",
            "make install",
            "The program needs no other libraries. Run the tests before you use it in earnest.",
            "Usage",
            "Open a queue with a path.",
            "Push a job, which may be any string.",
            "Option",
            "Meaning",
            "path",
            "where the file lies",
        ],
    ),
    "plain": (
        """<html><body><h1>On the weather of the valley</h1>
<p>The valley lies between two ridges, so the wind comes from the west or not at all. In spring the fog stays until noon.</p>
<p>I have kept a record of the rain since 1974. The wettest year was 2002, the driest 2018.</p>
<p>Snow has become rare. My neighbours remember winters when the road was closed for weeks.</p></body></html>""",
        [
            "On the weather of the valley",
            "The valley lies between two ridges, so the wind comes from the west or not at all. In spring the fog stays until noon.",
            "I have kept a record of the rain since 1974. The wettest year was 2002, the driest 2018.",
            "Snow has become rare. My neighbours remember winters when the road was closed for weeks.",
        ],
    ),
    "comments inside the article": (
        """<body><nav class="breadcrumb"><a href="/">Home</a> &raquo; <a href="/diy">DIY</a></nav><article class="story"><header><h1>A shelf without screws</h1></header>
<p>You need two boards, a saw and some patience. Cut a slot into each board, as wide as the other one is thick.</p><p>Slide the boards into each other and the shelf stands by itself.</p>
<section id="comments"><h3>Comments</h3><div class="comment"><span class="author">Mia</span><p>Mine wobbles a bit, any ideas?</p></div><div class="comment"><span class="author">Jon</span><p>Make the slots tighter.</p></div></section></article>
<aside class="sidebar"><h4>Popular</h4><a href="/x">A table from pallets</a></aside></body>""",
        [
            "A shelf without screws",
            "You need two boards, a saw and some patience. Cut a slot into each board, as wide as the other one is thick.",
            "Slide the boards into each other and the shelf stands by itself.",
        ],
    ),
    "hidden and noscript": (
        """<html><body><noscript>Please enable JavaScript to use this site.</noscript><div id="overlay" style="display: none"><h3>Subscribe!</h3><p>Get our best articles by mail every week.</p></div>
<div class="container"><div class="navbar"><a href="/">Home</a><a href="/blog">Blog</a></div><div class="article-body"><h1>Why the sky is blue</h1>
<p>Light from the sun holds all colours. On its way through the air the short waves are scattered far more than the long ones.</p>
<p>So from every direction some blue light reaches the eye, while the sun itself looks yellow.</p></div><div class="newsletter"><form><label>Your mail address</label><input><button>Subscribe</button></form></div></div></body></html>""",
        [
            "Why the sky is blue",
            "Light from the sun holds all colours. On its way through the air the short waves are scattered far more than the long ones.",
            "So from every direction some blue light reaches the eye, while the sun itself looks yellow.",
        ],
    ),
    "german": (
        """<html lang="de"><body><div id="kopf" class="header"><a href="/">Stadtanzeiger</a></div><ul class="menu"><li><a href="/politik">Politik</a></li><li><a href="/sport">Sport</a></li></ul>
<div class="artikel content"><h1>Neue Br&uuml;cke &uuml;ber den Fluss er&ouml;ffnet</h1><p>Nach vier Jahren Bauzeit ist die neue Brücke am Samstag für den Verkehr freigegeben worden.</p>
<p>Die Kosten stiegen von zwölf auf neunzehn Millionen Euro, weil der Boden weicher war als gedacht.</p><p>Für Radfahrer gibt es auf beiden Seiten einen eigenen Weg.</p></div>
<div class="footer"><a href="/impressum">Impressum</a> | <a href="/datenschutz">Datenschutz</a></div></body></html>""",
        [
            "Neue Brücke über den Fluss eröffnet",
            "Nach vier Jahren Bauzeit ist die neue Brücke am Samstag für den Verkehr freigegeben worden.",
            "Die Kosten stiegen von zwölf auf neunzehn Millionen Euro, weil der Boden weicher war als gedacht.",
            "Für Radfahrer gibt es auf beiden Seiten einen eigenen Weg.",
        ],
    ),
    "spanish": (
        """<html><body><header><h2>Revista del Mar</h2><nav><ul><li><a href="/">Inicio</a></li><li><a href="/archivo">Archivo</a></li></ul></nav></header><section class="entry-content"><h1>La vida de los pulpos</h1>
<p>Los pulpos son animales solitarios que viven entre las rocas y cambian de color en un instante.</p><blockquote>Un pulpo puede abrir un frasco desde dentro.</blockquote>
<p>Su vida es corta: la mayoría de las especies no pasa de dos años.</p></section><aside><h3>Lo más leído</h3><ul><li><a href="/1">El canto de las ballenas</a></li></ul></aside><footer>&copy; Revista del Mar</footer></body></html>""",
        [
            "La vida de los pulpos",
            "Los pulpos son animales solitarios que viven entre las rocas y cambian de color en un instante.",
            "Un pulpo puede abrir un frasco desde dentro.",
            "Su vida es corta: la mayoría de las especies no pasa de dos años.",
        ],
    ),
    "recipe": (
        """<html><body><div class="top"><a href="/">Kitchen Notes</a></div><div class="ad-slot"><p>Sharp knives for every cook. Order now!</p></div><main class="recipe"><h1>Lentil soup</h1><p>A soup for cold days that is ready in forty minutes.</p>
<h2>Ingredients</h2><ul><li>250 g lentils</li><li>2 carrots</li><li>1 onion</li></ul><h2>Method</h2><ol><li>Chop the onion and the carrots and fry them in a little oil.</li><li>Add the lentils and a litre of water and let it simmer.</li></ol></main>
<div class="social-links"><a href="#">Pin it</a><a href="#">Print</a></div><div id="footer"><p>Kitchen Notes, since 2009</p></div></body></html>""",
        [
            "Lentil soup",
            "A soup for cold days that is ready in forty minutes.",
            "Ingredients",
            "250 g lentils",
            "2 carrots",
            "1 onion",
            "Method",
            "Chop the onion and the carrots and fry them in a little oil.",
            "Add the lentils and a litre of water and let it simmer.",
        ],
    ),
    "svg, math and broken tags": (
        """<div class=menu><a href=/>Home</a> <a href=/maths>Maths</a></div><div class=post><h1>A sum to remember<p>The sum of the first n odd numbers is a square. <svg viewBox="0 0 9 9"/>For n = 3 we get 1 + 3 + 5 = 9.
<p>In symbols, <math><mi>s</mi><mo>=</mo><msup><mi>n</mi><mn>2</mn></msup></math> holds for every n &gt; 0, as induction shows.<p>The proof needs one line only.</div><div class=footer>&copy; The maths club</div>""",
        [
            "A sum to remember",
            "The sum of the first n odd numbers is a square. For n = 3 we get 1 + 3 + 5 = 9.",
            "In symbols, s=n2 holds for every n > 0, as induction shows.",
            "The proof needs one line only.",
        ],
    ),
    "wiki": (
        """<html><body><div id="page-head"><a href="/wiki/Main">Main page</a> <a href="/wiki/Random">Random page</a></div><div id="bodyContent"><h1>Basalt</h1><p>Basalt is a dark volcanic rock that forms when lava cools quickly at the surface.</p>
<div id="toc" class="toc"><h2>Contents</h2><ul><li><a href="#1">Formation</a></li><li><a href="#2">Uses</a></li></ul></div><h2>Formation</h2><p>Most of the ocean floor consists of basalt. On land it builds wide plains and tall columns.</p>
<h2>Uses</h2><p>It is crushed for roads, cut into tiles and spun into fibres.</p></div><div id="footer"><ul><li>This page was last edited on 4 May.</li><li><a href="/privacy">Privacy policy</a></li></ul></div></body></html>""",
        [
            "Basalt",
            "Basalt is a dark volcanic rock that forms when lava cools quickly at the surface.",
            "Formation",
            "Most of the ocean floor consists of basalt. On land it builds wide plains and tall columns.",
            "Uses",
            "It is crushed for roads, cut into tiles and spun into fibres.",
        ],
    ),
    "loose text": (
        """<html><body><center><b>Letters from the lighthouse</b></center><hr>It has rained for nine days now. The boat with the post could not land, and I am out of coffee.<br><br>
Yesterday a tired goose came down on the gallery and stayed the night. I gave it bread, which it did not like.<p>The lamp burns well. I read the old logbooks in the evening.<hr><a href="index.html">back to the index</a></body></html>""",
        [
            "Letters from the lighthouse",
            "It has rained for nine days now. The boat with the post could not land, and I am out of coffee. Yesterday a tired goose came down on the gallery and stayed the night. I gave it bread, which it did not like.",
            "The lamp burns well. I read the old logbooks in the evening.",
        ],
    ),
}

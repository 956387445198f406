"""The small labelled table: invented pages whose blocks carry one label each, in page order (1 main text, 0 not)."""

PAGES = [
    (
        """<html><head><title>Rivers in winter</title><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News of the day</a></li><li><a href="/c">Contact us</a></li></ul></nav>
<div class="ad">Buy two pairs of boots and get the third pair free until the end of the week at any store.</div>
<article><h1>Rivers in winter</h1><p>When the cold comes early the smaller rivers freeze from the banks inward and the ice grows thick enough to walk on.</p>
<p>It does.</p><p>Fish keep to the deep pools, where the water stays a little above freezing all through the season.</p></article>
<footer>&copy; rivers.example 2020 &middot; All words and pictures belong to their makers and may be used with leave.</footer></body></html>""",
        "000" "0" "1111" "0",
    ),
    (
        """<body><header><h1>The Daily Page</h1><p>Your paper since the old days</p></header>
<main><h2>Bridge closed</h2><p>The old bridge was closed on Monday after a crack was found in the second pier by a worker.</p>
<div class="promo">Sign up for our letter and never miss a story again, it is free.</div>
<p>Cars are sent round by the <a href="/mill">mill road</a>.</p><p>Yes.</p></main>
<aside><h3>Most read</h3><p>A long list of what other readers have liked this week, with pictures and with short words.</p><ul><li><a href="/1">Dog finds home</a></li><li><a href="/2">Rain again</a></li></ul></aside>
<footer><p>Imprint</p><p><a href="/p">Privacy</a></p></footer></body>""",
        "00" "11" "0" "11" "0000" "00",
    ),
    (
        """<body><div id="cookie-notice">We use cookies to make this site work and to learn how it is used. <a href="/ok">Accept</a></div>
<div class="menu"><a href="/a">Bread</a> <a href="/b">Cakes</a> <a href="/c">Pies</a></div>
<article><header><h1>Rye bread at home</h1></header><p>Mix the flour with the water and the starter and leave the bowl in a warm place over night.</p>
<ul><li>Flour</li><li>Water</li><li>Salt</li></ul><p>Bake for an hour.</p><form><p>Rate this recipe</p><p>Tell us in your own words how it turned out for you and your guests.</p></form>
<section class="comments"><h3>Comments</h3><p>I made this last week and the whole family ate it within a day, thank you so much for it.</p><p>Too salty!</p></section></article></body>""",
        "0" "0" "11" "111" "1" "00" "000",
    ),
    (
        """<body><div><a href="/">Start</a> | <a href="/shop">Shop</a> | <a href="/help">Help</a></div>
<div>The engine was first built in a shed behind the house, from parts that had been meant for a pump, and it ran for a whole summer before anyone from the town took note of it.</div>
<div>After that the orders came in faster than the two brothers could fill them, so they hired a smith and moved the works down to the canal where coal was cheap.</div>
<div>They sold the firm in the year of the flood, and the new owners kept the name and the yard for another twenty years before the works were closed for good.</div>
<div><a href="/1">Older posts</a> <a href="/2">Newer posts</a></div><div>Copyright</div></body>""",
        "0" "111" "00",
    ),
    (
        """<body><nav><a href="/x">X</a></nav><article><h1>Short note</h1><p>Gone fishing.</p><p>Back soon.</p></article>
<div class="sidebar"><p>About the writer of these notes, who lives by the sea and keeps bees and a boat.</p></div>
<div class="related"><a href="/r">You may also like this other note</a></div><footer>Made by hand</footer></body>""",
        "0" "111" "0" "0" "0",
    ),
    (
        """<body><ul class="nav"><li><a href="/de">Deutsch</a></li><li><a href="/fr">Français</a></li></ul>
<article><h2>On glass</h2><p>Glass is made of sand, soda and lime, melted together until the mass is clear.</p><blockquote>It is a slow water.</blockquote>
<p><a href="/src">Read the whole essay in the archive</a></p><div class="share">Share this</div><div class="ad">Glasses at half price this week only</div><pre>sand 70</pre></article>
<div role="contentinfo">Terms apply to all use of this site and its contents, see the small print.</div></body>""",
        "00" "111" "1" "00" "1" "0",
    ),
    (
        """<body><div>Log in</div><div>Cart (0)</div><h1>How tides work</h1><p>The moon pulls on the sea, and the water on the near side rises towards it while the water on the far side is left behind.</p>
<p>Twice a day the coast turns through these two hills of water, and so most harbours see two high tides and two low ones.</p><p>Where the sea bed is steep or the bay is narrow, the rise can be many times that of the open ocean, and boats must wait.</p>
<div><a href="/t1">Tide tables</a> <a href="/t2">Moon dates</a></div><div>Follow us</div></body>""",
        "00" "1" "111" "00",
    ),
    (
        """<body><main><p>The choir meets on Thursdays.</p><p>New voices are welcome at any time, and no one is asked to sing alone or to read from the page at first.</p><table><tr><td>May</td><td>Spring songs</td></tr></table></main>
<div id="newsletter"><p>Get our letter</p><p>We write four times a year, never more, and we do not give your address to anyone else at all.</p></div><footer><a href="/top">Top</a></footer></body>""",
        "11" "11" "00" "0",
    ),
    (
        """<body><table><tr><td><a href="/1">Front</a></td><td><a href="/2">Town</a></td><td><a href="/3">Sport and games</a></td></tr></table>
<div><h1>Market square reopens</h1><div>After two years of work the market square was given back to the town on Saturday, with new stones, new lamps and the old well in its middle.</div>
<div>Stalls stood until the evening.</div><div>The mayor thanked the masons, whose work had been held up twice, first by a hard winter and then by the bones of an old graveyard that nobody had known of.</div>
<div>More than <a href="/stalls">sixty stalls</a> were let on the first day, and the council means to add a covered hall for fish and cheese before the next summer.</div></div>
<div><a href="/r1"><div>Read also: how the old well was found again under the stones by a mason and his dog</div><div>Three hundred years under the square</div></a></div>
<div><a href="/r2"><div>Fish hall: council wants an answer before summer, traders want lower rents and a roof that holds</div></a></div>
<div><a href="/i">Imprint</a> <a href="/p">Privacy</a> <a href="/k">Contact</a></div></body>""",
        "000" "1" "1" "1" "1" "1" "00" "0" "0",
    ),
    (
        """<body><div><a href="/">All notes</a></div><div><a href="/tags">Tags</a></div>
<div><h2>Why bread goes stale</h2><p>Stale bread is not dry bread: the starch in the crumb turns back into crystals and binds the water that made it soft.</p>
<p>Warm it again and the crystals melt, which is why toast from an old loaf can taste fresh for a few minutes.</p><p>So never keep it cold.</p>
<p>A freezer stops the change, a fridge makes it faster, and a clay pot in a cool room is a fair middle way for a day or two.</p></div>
<div><p><a href="/n1">Next: five things to do with the crust when the crumb is gone and the soup is on</a></p><p><a href="/n2">Before: which flour for which loaf, with a table and the prices of this year</a></p></div>
<div><p><a href="/s">Send</a></p><p><a href="/pr">Print</a></p></div></body>""",
        "00" "1" "1" "1" "1" "1" "00" "00",
    ),
    (
        """<body><div><a href="/l">Library</a></div><div><a href="/c">Catalogue</a></div><div><a href="/o">Open hours</a></div><div>
<h1>Sorting without comparing</h1><section id="related-work"><h2>Related work</h2><p>Radix methods were used with punched cards long before there were computers, and most of what is said here was known to those who ran them.</p></section>
<section id="search-in-place"><h2>Searching in place</h2><p>When the keys fit the bins, a search needs one step; when they do not, the bins are searched in turn, and the order of the bins decides the cost.</p></section>
<p>Both ideas meet in the table at the end of this note, which lists the costs for each of the four layouts that we tried on our own machines.</p></div>
<div><a href="/d1">A long talk on sorting networks, held in the spring, with slides and a recording for members</a> <a href="/d2">Errata</a></div></body>""",
        "000" "1" "11" "11" "1" "0",
    ),
    (
        """<body><div><a href="/">Home</a> &gt; <a href="/g">Garden</a> &gt; <a href="/g/p">Ponds</a></div>
<div><p>A pond needs a shallow end, so that birds can drink and hedgehogs that fall in can climb out again without help.</p><p>Dig in autumn.</p><p>Line the pit with clay or with a sheet of rubber, weigh the edge down with stones, and let the rain do the filling through the winter.</p>
<p>By May there will be <a href="/w">water beetles</a>, and by the second year the first newts, if there is a ditch or another pond within a short walk.</p></div>
<div><a href="/g/1">Hedges that feed birds</a></div><div><a href="/g/2">Dead wood is not rubbish: why a pile of logs in a corner is worth more than any nest box you can buy</a></div><div><a href="/g/3">Moss</a></div><div><a href="/a">About us</a></div></body>""",
        "0" "1" "1" "1" "1" "000" "0",
    ),
    (
        """<body><div><a href="/">Harbour news</a></div><div>Since the year of the flood</div><div><a href="/b">Boats, ropes and sails for sale</a></div>
<div><h1>New crane for the east quay</h1><p>The crane came by sea in four parts and was put together on the quay by a crew of nine within two weeks.</p><p>It lifts forty tons.</p><p>The old one goes to the museum, where it will stand beside the steam winch and the bell of the first lightship.</p></div>
<div><a href="/t">Tide tables for the whole coast</a></div><div>Share this with your friends</div><div><a href="/m">Send it by mail to someone</a></div><div>Filed under ships and cranes</div><div><a href="/x">Older news</a></div></body>""",
        "000" "1" "1" "1" "1" "00000",
    ),
    (
        """<body><div>You are reading the plain edition</div><div><a href="/f">Go to the full edition</a></div><div>Text size small or large</div><div><a href="/l">Log in to your reader account</a></div>
<p>The night train is back: from the first of the month it runs three times a week between the coast and the hills.</p><p>Beds must be booked.</p><p>The line had been closed since the bridge was washed away, and for a long time no one thought that it would be opened again.</p>
<p>Tickets cost as much as they did then.</p><p>Those who want to take a bicycle should ask for the last carriage, which has hooks for twelve of them and a bench.</p></body>""",
        "0000" "1" "1" "1" "1" "1",
    ),
    (
        """<body><div><a href="/1">Hills, moors and old mines</a></div><div>Walks for every kind of weather</div><div><a href="/2">Coast</a></div><div>Pages for members of the club</div><div><a href="/3">Maps to print and take along</a></div>
<div><h1>Up the white hill</h1><p>Start at the mill and follow the brook until the path turns away from it at a stone with three marks.</p><p>Keep left there.</p><p>From the top one sees both rivers, the town between them and, when the air is clear after rain, the line of the sea.</p><p>The way down is steep.</p></div></body>""",
        "00000" "1" "1" "1" "1" "1",
    ),
    (
        """<body><div><a href="/">Clocks</a></div><div><a href="/w">Watches and small clocks of all kinds</a></div><div>Opening hours on request</div><div><a href="/s">Spare parts</a></div>
<article><h1>Winding</h1><p>Yes.</p><p>Wind a clock at the same hour of the day, and stop when the key will not go further without force.</p><h2>Oil</h2><p>Little.</p><p>One drop at each pivot is enough for three years; more runs along the plate and takes the good oil with it.</p></article>
<div><a href="/o">Oils and tools in our shop</a></div><div>All prices with tax</div><div><a href="/d">How to find us by train or bus</a></div></body>""",
        "0000" "111111" "000",
    ),
    (
        """<body><div>Welcome back to the reading room</div><div><a href="/n">New books of this month and the last</a></div><div>Twelve readers are here now</div><div><a href="/c">Chat</a></div>
<main><h1>Letters</h1><p>No.</p><p>The second volume holds the letters from the war years, many of which were thought to be lost until the attic was cleared.</p><p>Read slowly.</p></main>
<div><a href="/v">Volume one, with the early letters</a></div><div>Borrow up to six books</div><div><a href="/z">Desk</a></div></body>""",
        "0000" "1111" "000",
    ),
    (
        """<body><article><p>Rain.</p><p>It fell for nine days, and on the tenth the brook came into the lower street and stood there until Easter.</p><p><a href="/map">A map of the flood in three colours</a></p><p>Then it froze.</p><p>Boys skated from the church to the mill, and the post came by sledge, which it had not done since their fathers were young.</p></article><footer><a href="/e">End</a></footer></body>""",
        "11" "0" "11" "0",
    ),
    (
        """<body><main><h1>Knots</h1><p><a href="/k">See all knots with pictures</a></p><p>Three will do.</p><p>The bowline makes a loop that does not slip, the clove hitch holds a post, and the sheet bend joins two ropes of unlike size.</p></main></body>""",
        "1" "0" "11",
    ),
    (
        """<body><p>To whom it may concern: the well in the upper field is dry, and the one by the barn gives brown water since the spring.</p><p>Boil it.</p><p>A new pump has been asked for, and until it comes the cart will bring two barrels every morning before the bell.</p><div><a href="/w">Water board</a></div></body>""",
        "111" "0",
    ),
    (
        """<body><h1>Minutes of the meeting</h1><p>Ten members came, and the chair read the letter from the county about the road, the ditch and the trees along it.</p><p>Nobody spoke against it.</p><div><a href="/m1">Earlier minutes</a></div></body>""",
        "111" "0",
    ),
    (
        """<body><nav><a href="/h">Harbour board</a></nav><article><p>The north channel is closed to all boats above ten tons until the wreck has been raised and towed to the yard.</p></article></body>""",
        "0" "1",
    ),
    (
        """<body><div><a href="/u">Up to the list of all notices</a></div><p>Keys found on the bench by the pond can be had from the keeper, who is in the lodge until noon on every day but Sunday.</p></body>""",
        "0" "1",
    ),
    (
        """<body><article><h1>Lost and found</h1><p>One glove, left hand, red.</p><p>One cap.</p></article><footer><a href="/a">All lists</a></footer></body>""",
        "111" "0",
    ),
    (
        """<body><main><h1>A short poem</h1><p>Snow on the stile</p><p>and nobody to cross it</p><p>but the wind</p></main></body>""",
        "1111",
    ),
    (
        """<body><article><p>Two lines today.</p><p>More when the post has come.</p></article><div><a href="/y">Yesterday and the days before</a></div></body>""",
        "11" "0",
    ),
    (
        """<body><article><h1>What the ferry crew saw on the night of the storm</h1><p>They saw lights.</p><p>The mate wrote in the log that four lights stood in a row over the bank, and that they did not move when the ship did.</p></article></body>""",
        "111",
    ),
    (
        """<body><h1>How to keep apples sound until the spring</h1><p>Pick them dry and lay them on straw so that no two touch, with the stalks up and the windows shut against the frost.</p><p>Look at them once a week.</p><div><a href="/p">Pears, quinces and medlars</a></div></body>""",
        "111" "0",
    ),
    (
        """<body><article><p>The bell was cast in the yard behind the church.</p><p>It took two winters, and the first cast cracked when it was hung, so that the founder had to begin again with what was left.</p></article><footer>Parish archive</footer></body>""",
        "11" "0",
    ),
    (
        """<body><main><p>Chairs are at the back, please take one.</p><p>The talk begins at eight.</p></main><footer><a href="/n">Next talks in this room</a></footer></body>""",
        "11" "0",
    ),
]

"""Pages written by hand, apart from the training pages: (html, main text)."""

LOREM = [
    "The harbour froze over for the first time in thirty years, and the ferries stayed at their moorings until noon.",
    "Officials said that the ice breaker had been under repair since autumn; no replacement could be found in time.",
    "By evening the wind had turned, the floes drifted out to sea and the first boats left for the islands.",
    "Bäcker Jansen hat seinen Laden am Markt nach vierzig Jahren geschlossen, weil sich kein Nachfolger fand.",
    "Seine Kundinnen bedauern das sehr: Nirgends sonst gab es so gutes Brot, und nirgends sonst so viel Zeit.",
    "Le musée rouvre ses portes samedi après deux ans de travaux, avec une salle entière consacrée aux cartes anciennes.",
    "Les visiteurs pourront y voir un atlas de 1570, restauré feuille par feuille par une équipe de six personnes.",
    "El río bajó con tanta fuerza que se llevó el puente viejo, construido en 1887 y nunca reparado desde entonces.",
    "Mix the flour with the salt, add the water slowly and knead the dough for ten minutes until it is smooth.",
]
A, B, C, D, E, G, H, I, J = LOREM
NAV = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul>"

PAGES = [
    (f"<html><body><nav>{NAV}</nav><main><h1>Frozen harbour</h1><p>{A}</p><p>{B}</p></main><aside><h4>Most read</h4>{NAV}</aside><footer><p>All rights reserved.</p></footer></body></html>", f"Frozen harbour\n{A}\n{B}"),
    # Names that say nothing; reader comments by structure alone.
    (f"<body><div class=a1>{NAV}</div><div class=b7><h1>Ice</h1><p>{A}<p>{B}<p>{C}</div><div class=c3><h3>2 x</h3><div class=c9><b>Tom</b><p>Nice.</p></div><div class=c9><b>Ann</b><p>I was there.</p></div><div class=c9><b>Bo</b><p>Cold!</p></div></div><div class=z>{NAV}</div></body>", f"Ice\n{A}\n{B}\n{C}"),
    # Another language's names.
    (f"<body><div id=kopfzeile>{NAV}</div><div id=inhalt><h1>Das Ende einer Bäckerei</h1><p>{D}</p><p>{E}</p></div><div class=kommentare><h3>Kommentare</h3><div class=kommentar><p>Schade.</p></div><div class=kommentar><p>Sehr schade.</p></div></div><div id=fusszeile><p>Impressum</p></div></body>", f"Das Ende einer Bäckerei\n{D}\n{E}"),
    # An element closed in itself, a stray quote, an end tag that never comes.
    (f'<article><h1>Musée</h1><p><svg class="i"/>{G}</p><p title="a>{H}</p></article><footer><svg></svg><a href="/m">Mentions</a></footer>', f"Musée\n{G}\n{H}"),
    (f"<header><a href='/'>Logo</a></header><article><p>{I}<p>{A}<div class='advert'><p>Buy boots today!</p></div><p>{B}</article><footer>© 2024</footer>", f"{I}\n{A}\n{B}"),
    (f"<table><tr><td>{NAV}</td><td><h2>Bread</h2><p>{J}</p><ol><li>Shape the loaf and let it rest.</li><li>Bake it for forty minutes.</li></ol></td></tr></table>", f"Bread\n{J}\nShape the loaf and let it rest.\nBake it for forty minutes."),
    (f"<body><div id='cookie-notice'><p>We use cookies to make this site better for you.</p><button>OK</button></div><nav>{NAV}</nav><article><header><h1>Ferries</h1></header><section><h2>Morning</h2><p>{A}</p></section><section><h2>Evening</h2><p>{C}</p></section></article></body>", f"Ferries\nMorning\n{A}\nEvening\n{C}"),
    (f"<body><div><div><nav>{NAV}</nav><article><h1>Q &amp; A</h1><blockquote><p>{B}</p></blockquote><p>{C} &lt;sic&gt;</p><form><label>Your mail</label><input><button>Send</button></form></article></div></div></body>", f"Q & A\n{B}\n{C} <sic>"),
    (f"<body><nav>{NAV}</nav><article><h1>Twice</h1><p>{A}</p><p>{A}</p></article><section class='reader-comments'><h3>Readers say</h3><article class='comment'><p>{E}</p></article><article class='comment'><p>{D}</p></article></section></body>", f"Twice\n{A}\n{A}"),
    (f"<body><ul><li><a href='/'>Home</a></ul><p>{H}</p><p>{I}</p><script>document.write('<p>no</p>')</script><p>{J}</p></body>", f"{H}\n{I}\n{J}"),
    # Bare pages: one paragraph, no heading, line breaks only, text that stands in no element.
    (f"<html><body><p>{A}</p></body></html>", A),
    (f"<p>{D}", D),
    (f"{C}", C),
    (f"<html><body><div class=x1>{A}<br>{B}<br><br>{C}</div><div class=x2><a href='/'>Home</a> <a href='/n'>News</a></div></body></html>", f"{A} {B} {C}"),
    (f"<body><h2>Ferries</h2>{B}<br>{C}</body>", f"Ferries\n{B} {C}"),
    (f"<body><div id=menue>{NAV}</div><div id=text>{H}<br><br>{G}</div></body>", f"{H} {G}"),
    (f"<body><p>{E}</p><p>{D}</p><p><a href='/zurueck'>Zurück</a></p></body>", f"{E}\n{D}"),
    (f"<body><div><p>{J}</p></div><footer><p>© 2021 The Baker</p></footer></body>", J),
    (f"<html><head><title>T</title></head><body><center><font size=4>Un atlas</font></center><p>{G}</p><hr><p>{H}</p></body></html>", f"Un atlas\n{G}\n{H}"),
    (f"<body><nav>{NAV}</nav><div class=m4><span>{I}</span></div><form><input><button>Buscar</button></form></body>", I),
]

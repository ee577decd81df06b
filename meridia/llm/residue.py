"""p10: template residue and error-page text.

Character n-gram models of filler, of notices and errors and of unfilled slots,
learnt from wording that public software and page templates use, and of the
whole corpus's prose give each position of a text a log likelihood ratio.
Windows of a high ratio localise residue; the likelihood of what they cover,
where it isn't code or quotation, decides, and the covered share excludes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.session import table

N, BITS = 5, 20
#: Prose counts of more n-grams than this are scaled down to so many, so that ratios mean the same for any corpus from a few megabytes on; a smaller one tells less and makes all ratios lower.
PROSE_GRAMS = 4_000_000
#: Counting takes so many characters at once; a partition's counts leave it in so many parts.
AT_ONCE, PARTS = 1_000_000, 16
#: For wording and for slots: a window's width in characters, and the mean ratio at which it is residue. A passage of wording also needs the least sum.
WINDOWS, RATIOS, LEAST_SUM = (20, 3), (1.2, 1.5), 20.0
#: A slot needs this sum over its characters; a mark that only slots have counts as so much, as does a note's first word for its sentence.
SLOT_SUM, MARK = 20.0, 18.0
#: A document goes where more than this share of it is residue: any, as the rest of it is no content of its own to rely on.
LEAST_COVERAGE = 0.0

# The wording of residue. Slots stand in SLOT's place.
FIELDS = ("name", "title", "area", "date", "region", "district", "population", "mayor", "author name", "year founded", "river_length", "image", "source", "short description", "elevation", "value", "text", "1", "2", "3", "Ortsname", "Einwohnerzahl", "köy adı", "nüfus", "πληθυσμός", "όνομα χωριού")
SLOTS = ("{{{%s}}}", "[insert %s here]", "[your %s goes here]", "[INSERT %s]", "[[INSERT %s]]", "<%% %s %%>", "<%%= %s %%>", "%%%s%%", "${%s}", "#{%s}", "{{ page.%s }}", "{{ %s }}", "<%s>", "[%s]", "__%s__", "<insert %s>", "*** %s section goes in this spot ***", "@@%s@@", "$$%s$$", "%%%%%s%%%%", "{%s}", "[hier %s einfügen]", "[%s buraya yazın]", "[εισάγετε %s εδώ]", "(text about %s to follow)", "(%s to be filled in)", "{%% %s %%}", "&lt;%s&gt;", "[[%s]]", "TK TK TK", "[BITTE AUSFÜLLEN]", "[ΣΥΜΠΛΗΡΩΣΤΕ]", "[BURAYI DOLDURUN]", "XXXX", "[...]")
CONTEXTS = (" SLOT ", " in SLOT.", " (SLOT) ", "=SLOT|", "= SLOT\n", "SLOT, ", "\nSLOT")
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.",
    "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt. Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet.",
    "Curabitur pretium tincidunt lacus. Nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra, est eros bibendum elit, nec luctus magna felis sollicitudin mauris. Integer in mauris eu nibh euismod gravida.",
    "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Vestibulum tortor quam, feugiat vitae, ultricies eget, tempor sit amet, ante. Donec eu libero sit amet quam egestas semper.",
    "Cum sociis natoque penatibus et magnis dis parturient montes, nascetur ridiculus mus. Quisque rutrum aenean imperdiet. Etiam ultricies nisi vel augue. Nam quam nunc, blandit vel, luctus pulvinar, hendrerit id, lorem.",
    "Maecenas tempus, tellus eget condimentum rhoncus, sem quam semper libero, sit amet adipiscing sem neque sed ipsum. Praesent porta nec ergo in urna. Phasellus viverra nulla ut metus varius laoreet ornare pulvinar.",
    "Text goes here. Your text here. Body text goes here. Copy goes here. Caption goes here. Title goes here. Insert your text here. Enter text here. Type your text here.",
    "Sample text. Sample content. Dummy text. Dummy content. Dummy copy. Placeholder text. Placeholder content. Example text. Filler text. Text text text text text. Test test test test.",
    "This is a placeholder and will be replaced with the final text. This is placeholder copy; replace it before publishing. This text is a stand-in for the real article. Swap this out later.",
    "Add a short introduction here. Write a few sentences about the subject here. Write a paragraph here. Describe your subject in two or three sentences. Tell your readers about it.",
    "Click here to edit this text. Double-click to edit this block. I am a text block. Click edit button to change this text. This is your first paragraph. Start writing here. Edit me.",
    "bla bla bla bla bla bla bla bla blah blah blah blah blah yada yada yada asdf asdf asdf TK TK TK TK xxx xxx xxx",
    "TODO: add text. TODO: describe this. TODO write this section. TODO: fill in. FIXME add a source. FIXME: check with the editor and complete. FIXME needs a source.",
    "TBD. TBD - to be written. TBA - to be announced. To be written. To be done. To be completed. (to be filled in) (to be added) Text to follow. More to follow. More to come.",
    "Coming soon. Content coming soon. Content to be added later. This section is under construction. This section will be written later. This page is intentionally left blank.",
    "Text folgt. Inhalt folgt. Hier steht bald mehr. Blindtext. Dies ist ein Platzhalter. Hier Text einfügen. Beispieltext. Dieser Abschnitt wird noch geschrieben. Noch zu ergänzen.",
    "Το κείμενο θα προστεθεί αργότερα. Εδώ μπαίνει το κείμενο. Κείμενο προς συμπλήρωση. Δείγμα κειμένου. Η ενότητα θα γραφτεί αργότερα. Υπό κατασκευή.",
    "Metin buraya gelecek. Metni buraya yazın. Örnek metin. Bu bölüm daha sonra yazılacak. İçerik yakında eklenecek. Yapım aşamasında. Doldurulacak.",
)
EDITOR_NOTES = ("TODO: add the %s of this article", "FIXME %s needs a source, check with editor", "TBD - %s to be added", "%s to be written", "*** %s goes here ***", "*** insert %s section in this place ***")
NOTICES = (
    "404 Not Found. Not Found. The requested URL was not found on this server. Additionally, a 404 Not Found error was encountered while trying to use an ErrorDocument to handle the request.",
    "403 Forbidden. You don't have permission to access this resource on this server. 403 Access Denied. Access refused. 401 Unauthorized. 400 Bad Request. Your browser sent a request that this server could not understand.",
    "500 Internal Server Error. The server encountered an internal error or misconfiguration and was unable to complete your request. Internal error. Internal fault. Please contact the server administrator.",
    "503 Service Unavailable. Service not available. The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.",
    "502 Bad Gateway. The proxy server received an invalid response from an upstream server. 504 Gateway Timeout. Gateway timed out. 504 Gateway Time-out. The gateway did not receive a timely response.",
    "408 Request Timeout. 410 Gone. The requested resource is no longer available on this server. 429 Too Many Requests. 451 Unavailable For Legal Reasons.",
    "HTTP 404\n\nSorry, this page could not be found. HTTP ERROR 500\n\nSorry, an error occurred. HTTP Status 503 - Sorry, the service is unavailable. Reference: 0a1b2c3d4e. Request ID: 9f8e7d. Incident: 7edafb7a. Error ID 4f3e2d.",
    "Error 404 - page not found. Error 500 - internal server error. Error 503 - service unavailable. Error 403 - forbidden. Error: the server at example.org could not be reached. The server could not deliver the page. The document could not be delivered.",
    "Sorry, the page you are looking for could not be found. Oops! That page can't be found. It looks like nothing was found at this location. We can't find the page you requested. Page not found.",
    "Whoops, looks like something went wrong. Something broke. Oops, an error occurred. This page isn't working. We're sorry, but something went wrong. An unexpected error has occurred. Could not open this page right now. Could not load the article.",
    "Please try again in a few minutes. Please try again in 30 seconds. Try again later. Please reload the page. Refresh the page. Reload to try again.",
    "This site is down for maintenance. The database is locked for maintenance. This wiki is currently in read-only mode. The server is read-only until 12:00. Scheduled maintenance. Back soon. Node db1.example.org is down.",
    "Traceback (most recent call last): File \"app.py\", line 12, in render_page raise TimeoutError: timed out. ValueError: invalid literal. KeyError raised at 290 in main.",
    "Exception in thread \"main\" java.lang.NullPointerException at com.example.Main.main(Main.java:5). Caused by: java.sql.SQLException: Connection refused. java.net.SocketTimeoutException: Read timed out.",
    "Uncaught TypeError: Cannot read properties of undefined (reading 'length'). ReferenceError: x is not defined. Segmentation fault (core dumped). Server Error in '/' Application. Runtime Error.",
    "Lua error in Module:Name at line 12: attempt to index a nil value. Script error: No such module \"Name\". Script error: The function \"main\" returned a nil value at line 7. Script error: module returned no value at line 45.",
    "<strong class=\"error\">Template loop detected: Template:Name</strong> <strong class=\"error\">Template recursion depth limit exceeded (40)</strong> Template include size is too large.",
    "<strong class=\"error\">Expression error: Unexpected < operator.</strong> Expression error: Unrecognized word \"name\". Expression error: Missing operand for +. Expression error: unexpected operator / in value.",
    "Cite error: The named reference name was invoked but never defined. Cite error: There are ref tags on this page, but the references will not show. Cite error: the named note has no content.",
    "Failed to parse (syntax error). Error creating thumbnail: File missing. Failed to load map: tile server returned 503. Failed to render image: the tile service answered with a timeout. Failed to load resource: the server responded with a status of 404.",
    "Fatal error: Allowed memory size of 134217728 bytes exhausted (tried to allocate 20480 bytes) in /var/www/html/includes/parser.php on line 2320. Fatal: out of memory, 128 MB used up in parser.inc on line 10.",
    "Fatal error: Uncaught Error: Call to undefined function in index.php on line 10. Stack trace: #0 {main} thrown. Warning: Undefined variable in page.php on line 3. Parse error: syntax error, unexpected end of file. Maximum execution time of 30 seconds exceeded.",
    "Warning: mysqli_connect(): (HY000/2002): Connection refused. Error establishing a database connection. Database error. A database query error has occurred. Database query failed: connection to localhost:3306 timed out after 30 s. MySQL server has gone away.",
    "You have an error in your SQL syntax; check the manual that corresponds to your MySQL server version. SQLSTATE[HY000] [2002] No such file or directory. Could not connect to the database server. ERROR: no connection to host db.example.org:5432.",
    "upstream connect error or disconnect/reset before headers. reset reason: connection failure. no healthy upstream. Connection timed out. Connection reset by peer. Host not found.",
    "You need to enable JavaScript to run this app. This app works best with JavaScript enabled. This application requires JavaScript. Enable scripts and reload the page. Please enable JavaScript to view this page.",
    "JavaScript is disabled in your browser. JavaScript is turned off. JavaScript is not enabled. Please switch on JavaScript in your browser to read this page. Please turn it on to continue. It looks like your browser does not support scripts.",
    "For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser. To view this site you need a browser with JavaScript enabled.",
    "Your browser blocked scripts. A script required to display this page was blocked. Please allow scripts for this site and refresh. Please disable your ad blocker. This site requires cookies and scripts.",
    "Checking your browser before accessing example.org. Verifying you are human. This may take a few seconds. example.org needs to review the security of your connection before proceeding. Checking that your connection is secure. Ray ID: 44cfe507",
    "Please confirm that you are not a robot. JavaScript and cookies must be enabled to continue. Complete the captcha to continue. Enable cookies. Sorry, you have been blocked.",
    "You must be logged in to view this page. Please log in to continue. Login required. Your session has expired. Your session has timed out. Please sign in again. Log in again to continue. Sign in to keep reading. Subscribe to read the full article.",
    "<html><head><title>404 Not Found</title></head>\n<body><h1>Not Found</h1><p>Error 404 - not found.</p><hr><address>Apache Server at example.org Port 80</address></body></html>",
    "<html>\n<head><title>502 Bad Gateway</title></head>\n<body>\n<center><h1>502 Bad Gateway</h1></center>\n<hr><center>nginx/1.18.0</center>\n</body>\n</html>",
    "<noscript>You need to enable JavaScript to run this app.</noscript> <noscript>Please enable JavaScript.</noscript>",
    "Home | About | Search | Contact | Help\n\nReturn to the main page\n\nBack to the home page\n\nGo back",
    "Fehler 404: Die Seite wurde nicht gefunden. Die gewünschte Seite konnte nicht gefunden werden. Interner Serverfehler. Zugriff verweigert. Der Dienst ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später erneut. Die Datenbank ist derzeit nicht erreichbar.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen. JavaScript ist deaktiviert. Sie müssen sich anmelden, um diese Seite zu sehen. Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.",
    "Σφάλμα 404: Η σελίδα δεν βρέθηκε. Η σελίδα που αναζητάτε δεν υπάρχει. Εσωτερικό σφάλμα διακομιστή. Η υπηρεσία δεν είναι διαθέσιμη προσωρινά. Παρακαλώ δοκιμάστε ξανά αργότερα. Η βάση δεδομένων δεν αποκρίνεται.",
    "Ενεργοποιήστε τη JavaScript στον περιηγητή σας για να δείτε αυτή τη σελίδα. Η JavaScript είναι απενεργοποιημένη. Πρέπει να συνδεθείτε για να δείτε αυτή τη σελίδα. Η συνεδρία σας έληξε.",
    "Hata 404: Sayfa bulunamadı. Aradığınız sayfa bulunamadı. Sunucu hatası. Erişim engellendi. Hizmet şu anda kullanılamıyor. Lütfen daha sonra tekrar deneyin. Veritabanına bağlanılamadı.",
    "Bu sayfayı görüntülemek için tarayıcınızda JavaScript'i etkinleştirin. JavaScript devre dışı. Bu sayfayı görmek için giriş yapmalısınız. Oturumunuzun süresi doldu. Lütfen tekrar giriş yapın.",
)
#: Words that programmers and editors begin a note to themselves with.
_NOTE = re.compile(r"\s*(?:TODO|FIXME|TBD|TBC|TBA)\b\s*[:\-–]")
#: Whole passages that code, nowiki marks or a quotation hold.
_CODE = re.compile(r"<(nowiki|syntaxhighlight|code|pre|source)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_QUOTED = re.compile(r"\"[^\"\n]{0,300}\"|„[^“\n]{0,300}“|“[^”\n]{0,300}”|«[^»\n]{0,300}»|(?<!')''(?!')[^'\n]{0,300}''(?!')")
_END = re.compile(r"[.!?>](?=\s|$)|\n|</?(?:noscript|h1|hr|body|title)\b[^>]*>")
_WIKI = re.compile(r"<ref\b[^>]*/>|</?ref\b[^>]*>|\{\{\s*(?:citation needed|As of|reflist|stub|coord|DEFAULTSORT|Short description)[^{}]{0,80}\}\}", re.I)
# Tags and switches that are no slots, and marks of an unfilled slot, whatever its carrier.
_TAGS = "a|abbr|b|big|blockquote|body|br|center|cite|code|del|div|em|font|gallery|h[1-6]|head|hr|html|i|img|includeonly|ins|kbd|li|link|math|meta|noinclude|noscript|nowiki|ol|onlyinclude|p|poem|pre|ref|references|s|samp|script|section|small|span|strike|strong|style|sub|sup|syntaxhighlight|table|tbody|td|th|thead|timeline|tr|tt|u|ul|var"
_SWITCHES = "NOTOC|TOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NONEWSECTIONLINK|NOGALLERY|HIDDENCAT|INDEX|NOINDEX|STATICREDIRECT|DISAMBIG|NOCONTENTCONVERT|NOTITLECONVERT|EXPECTUNUSEDCATEGORY"
_FIELD = r"[A-Za-zÄÖÜäöüßÇĞİÖŞÜçğıöşüΑ-Ωα-ωά-ώ0-9][\w .'-]{0,40}"
SLOT_MARKS = re.compile(
    rf"\{{\{{\{{\s*{_FIELD}\s*\}}\}}\}}|\{{%\s*{_FIELD}\s*%\}}|&lt;[^\W\d_][\w -]{{1,30}}&gt;|\[\[?(?:placeholder|PLACEHOLDER)\]?\]|\[(?i:name|date|title|place|number|year|source|author) of [^\[\]|\n]{{2,40}}\](?!\()|(?<!\w)TK(?:\s+TK)+(?!\w)|<%=?\s*{_FIELD}\s*%>|\$\{{\s*{_FIELD}\s*\}}|#\{{\s*{_FIELD}\s*\}}|\{{\{{\s*page\.{_FIELD}\s*\}}\}}|(?<![\w%])%[A-Z][A-Z_]{{2,30}}%(?!\w)"
    rf"|\[\[?\s*(?:insert|your|enter|add|fill in|put|INSERT|YOUR|ENTER)\b[^\[\]|]{{1,60}}\]\]?|\[(?:BITTE AUSFÜLLEN|BITTE ERGÄNZEN|ΣΥΜΠΛΗΡΩΣΤΕ|[A-ZÄÖÜÇĞİŞΑ-Ω]{{3,}}(?:[ _][A-ZÄÖÜÇĞİŞΑ-Ω]+)*)\](?!\()"
    rf"|%%\w[\w ]{{1,40}}%%|\*\*\*\s[^*\n]{{3,60}}\s\*\*\*|(?<!\w)XX(?:XX)+(?!\w)|@@\w+@@|\$\$\w+\$\$|(?<!_)__(?!(?:{_SWITCHES})__)[A-Z][A-Z_ ]{{1,40}}__(?!_)"
    rf"|(?<![\w{{$#%|])\{{[^\W\d_][\w .-]{{1,30}}\}}(?!\}})|<(?!(?i:{_TAGS})>)[^\W\d_][\w -]{{1,30}}>|\([Tt]ext about [^()\n]{{2,40}} to follow\)"
    rf"|\[[^\[\]|\n]{{0,50}}\b(?:einfügen|eintragen|ausfüllen|buraya|yazın|girin|doldurun|εισάγετε|συμπληρώστε|εδώ)\b[^\[\]|\n]{{0,50}}\]"
)


def _shapes() -> np.ndarray:
    """For each of the first code points what a slot's model sees of it: its case, that it's a digit, or the sign itself; X and blanks stay."""
    out = np.arange(0x500, dtype=np.uint32)
    for c in range(0x500):
        ch = chr(c)
        if ch.isdigit():
            out[c] = 48
        elif ch.isalpha() and ch != "X":
            out[c] = 65 if ch.isupper() else 97
    return out


_SHAPE = _shapes()


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _codes(text: str, kind: int) -> np.ndarray:
    """The characters as the model of a kind sees them: letters in lower case with digits alike, or shapes."""
    if kind:
        return _SHAPE[np.minimum(_raw(text), 0x4FF)]
    low = text.lower()
    a = _raw(low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)).copy()
    a[(a >= 48) & (a <= 57)] = 48
    return a


def _grams(a: np.ndarray) -> np.ndarray:
    """A hashed n-gram for each position but the last N - 1."""
    n = max(0, len(a) - N + 1)
    h = np.zeros(n, np.uint32)
    for k in range(N):
        h *= np.uint32(0x01000193)
        h ^= a[k : k + n]
        h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BITS)


def _counts(texts: list[str], kind: int) -> np.ndarray:
    return np.bincount(_grams(_codes("\n\n".join(texts), kind)), minlength=1 << BITS).astype(np.float64) if texts else np.zeros(1 << BITS)


def seeds() -> list[list[str]]:
    """Filler and notices, and apart from them slots, to learn from."""
    upper = ("%%%s%%", "[%s]", "[INSERT %s]", "[[INSERT %s]]", "__%s__")

    def slot(s: str, f: str) -> str:
        f = f.upper().replace(" ", "_") if s in upper else f
        return s.replace("%s", f).replace("%%", "%")

    slots = [c.replace("SLOT", slot(s, f)) for s in SLOTS for c in CONTEXTS for f in FIELDS]
    notes = [n % f for n in EDITOR_NOTES for f in FIELDS]
    return [list(FILLER) * 3 + notes, list(NOTICES), slots]


def fit(natural: list[np.ndarray]) -> np.ndarray:
    """float32 [2, 2**BITS]: the log ratio of each hashed n-gram against prose, in the likelier of filler and notices, and in the shapes of slots; 0 for what none has seen.

    natural: the counts of all texts' n-grams, as wording and as shapes.
    """
    natural = [c * min(1.0, PROSE_GRAMS / max(1.0, c.sum())) for c in natural]
    soft, total = 2.0, natural[0].sum() + 1.0

    def ratio(texts: list[str], kind: int) -> np.ndarray:
        c = _counts(texts, kind)
        size = c.sum() + 1.0
        # smoothing in proportion to size leaves unseen n-grams at 0
        return np.log((c + soft * size / total) / size) - np.log((natural[kind] + soft) / total)

    filler, notices, slots = (ratio(t, k) for t, k in zip(seeds(), (0, 0, 1)))
    return np.clip(np.stack([np.maximum(filler, notices), slots]), -4.0, 6.0).astype(np.float32)


def passages(text: str, ratios: np.ndarray, kind: int) -> list[tuple[int, int, float]]:
    """(start, end, sum) of the stretches whose windows reach the ratio of a kind, 0 for wording, 1 for slots."""
    return _stretches(_grams(_codes(text, kind)), ratios, kind)


def _stretches(grams: np.ndarray, ratios: np.ndarray, kind: int) -> list[tuple[int, int, float]]:
    g = ratios[kind][grams]
    if not len(g):
        return []
    w = min(WINDOWS[kind], len(g))
    cum = np.concatenate([[0.0], np.cumsum(g, dtype=np.float64)])
    high = (cum[w:] - cum[:-w]) >= RATIOS[kind] * w
    if not high.any():
        return []
    edge = np.diff(np.concatenate([[0], high.astype(np.int8), [0]]))
    return [(int(b), int(e - 1 + w + N - 1), float(cum[min(len(g), e - 1 + w)] - cum[b])) for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def blanked(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: " " * len(m[0]), text)


def _sentences(free: str, b: int, e: int) -> Iterator[tuple[int, int]]:
    """The sentences, of any length, that the stretch from b to e meets."""
    begin = 0
    for m in _END.finditer(free, max(0, free.rfind("\n", 0, b))):
        if m.end() > b:
            yield begin if begin else max(0, free.rfind("\n", 0, b)), m.end()
            if m.end() >= e:
                return
        begin = m.end()
    yield begin if begin else max(0, free.rfind("\n", 0, b)), len(free)


def residue(text: str | None, ratios: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's residue, kind 'slot' or 'wording'; [] for null and empty texts.

    Passages within code, nowiki marks and quotation are read but don't count.
    """
    if not text:
        return []
    low = text
    if "<" in low:
        low = blanked(low, _CODE)
    slots, wording = passages(low, ratios, 1), passages(low, ratios, 0)
    if not slots and not wording:
        return []
    free = blanked(blanked(low, _WIKI), _QUOTED)
    out = []
    shape = None
    for b, e, _ in slots:
        for m in SLOT_MARKS.finditer(free, max(0, free.rfind("\n", 0, b)), min(len(text), e + 48)):
            if m.end() < b or (out and out[-1][0] >= m.start()):
                continue
            shape = ratios[1][_grams(_codes(low, 1))] if shape is None else shape
            if MARK + float(shape[max(0, m.start() - N) : m.end()].clip(-1.0).sum()) >= SLOT_SUM:
                out.append((m.start(), m.end(), "slot"))
    done = 0
    for b, e, _ in wording:
        # each sentence that the passage meets decides for itself, not by its likeliest words alone
        for x, y in _sentences(free, max(done, b), e) if e > done else ():
            x = max(x, done)
            if y - max(x, b) < 6 or min(y, e) - x < 6:
                continue
            done = y
            g = ratios[0][_grams(_codes(free[x:y], 0))]
            likely = g.sum() + (MARK if _NOTE.match(free, x) else 0.0)
            if len(free[x:y].strip()) >= 0.6 * (y - x) and likely >= min(LEAST_SUM, 0.8 * len(g)):
                out.append((x, y, "wording"))
    return out


def prose_counts(documents: DataFrame, text: str = "text") -> list[np.ndarray]:
    """The n-gram counts of all texts, as wording and as shapes.

    A partition counts into arrays of fixed size; these are summed part by
    part, in two steps, so that no task takes in more than about the root of the
    partitions' number, and 2 * 2**BITS numbers reach the driver whatever the corpus.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        held, size = [], 0

        def flush() -> None:
            for kind in (0, 1):
                sums[kind] += np.bincount(_grams(_codes("\n\n".join(held), kind)), minlength=1 << BITS)

        for part in parts:
            for t in part[text]:
                for at in range(0, len(t) if t else 0, AT_ONCE):
                    held.append(t[at : at + AT_ONCE + N - 1])
                    size += len(held[-1])
                    if size >= AT_ONCE:
                        flush()
                        held, size = [], 0
        flush()
        if sums.any():
            yield pd.DataFrame([(k, p, zlib.compress(x.tobytes(), 1)) for k in (0, 1) for p, x in enumerate(np.split(sums[k], PARTS))], columns=["kind", "part", "counts"])

    def add(group: pd.DataFrame) -> bytes:
        return zlib.compress(sum(np.frombuffer(zlib.decompress(x), np.int64) for x in group.counts).tobytes(), 1)

    schema = "kind int, part int, counts binary"
    total = lambda key, g: pd.DataFrame([(key[0], key[1], add(g))], columns=["kind", "part", "counts"])
    each = documents.select(text).mapInPandas(count, schema)
    salts = max(1, int(documents.rdd.getNumPartitions() ** 0.5))
    some = each.withColumn("salt", F.spark_partition_id() % salts).groupBy("kind", "part", "salt").applyInPandas(total, schema)
    rows = some.groupBy("kind", "part").applyInPandas(total, schema).collect()
    held = {(r.kind, r.part): np.frombuffer(zlib.decompress(r.counts), np.int64) for r in rows}
    none = np.zeros((1 << BITS) // PARTS, np.int64)
    return [np.concatenate([held.get((k, p), none) for p in range(PARTS)]).astype(np.float64) for k in (0, 1)]


def residue_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, passages, coverage): the documents that are or hold residue, with the share of their characters it covers.

    The prose model counts every text; each is then read whole, where it lies.
    Null, empty and blank texts hold none. Columns other than key and text are
    not read.
    """
    ratios = documents.sparkSession.sparkContext.broadcast(fit(prose_counts(documents, text)))
    kind = dict(documents.dtypes)[key]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for d, t in zip(part[key], part[text]):
                if found := residue(t, ratios.value):
                    rows.append((d, len(found), min(1.0, sum(e - b for b, e, _ in found) / len(t))))
            yield pd.DataFrame(rows, columns=[key, "passages", "coverage"])

    return documents.select(key, text).mapInPandas(scan, f"{key} {kind}, passages int, coverage double")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents")).where(F.col("coverage") > LEAST_COVERAGE).select("doc_id")

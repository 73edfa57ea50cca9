"""Problem 5: the main body of web pages.

A page is a tree: the page, its containers (lines between blanks), their blocks (neighbouring lines of one kind) and the
paragraphs. Every paragraph passes points for its length and its commas to its block, and half of them to its container;
a node's score is its points, discounted by its link density. The best node of all chunks of the page is the heart of
the body. Its siblings are kept if they are text without any link, or have SIBLING of its score; lists without links; and
up to HEADINGS labels directly before what is kept. More labels than that are a menu, whatever their words.

Text has lost the markup of its links, so link text is told by structure: short lines, or parts of lines between
separators, that come again on PAGES pages of a site or on SITES sites (with numbers and the site's name masked), rows of short parts,
runs of labels, and the labels below a link that heads them. Word lists of menus, notices, teasers and footers
stand beside it for sites with few pages; the README says what is found without them. The page's own title is body.

Defined results: null texts have no lines; a chunk stored twice counts once; a page whose URL is unknown is read without
its site's name; blank lines are never boilerplate; a chunk without any body line has an empty body; lines are those
between \\n; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.session import cut, small

# Words of menus, footers and buttons in English, German, French and Spanish.
LINK_WORDS = frozenset("""
home|about|about us|contact|contact us|docs|documentation|guides|blog|news|events|pricing|community|changelog|courses|downloads|topics|notes
search|sign in|sign up|log in|login|log out|register|account|my account|menu|help|faq|support|careers|jobs|press|archive|categories|tags|rss|feed|sitemap|team|shop|cart|learn|talks|podcast|videos|forum
startseite|über uns|kontakt|hilfe|notizen|themen|suche|anmelden|abmelden|neuigkeiten|kurse|veranstaltungen|preise|gemeinschaft|menü|registrieren|archiv|karriere
accueil|à propos|aide|carnets|thèmes|nouveautés|cours|rechercher|recherche|connexion|se connecter|événements|tarifs|communauté|plan du site
inicio|acerca de|contacto|ayuda|apuntes|temas|novedades|buscar|entrar|cursos|eventos|precios|comunidad|iniciar sesión|registrarse|mapa del sitio
privacy|privacy policy|terms|terms of use|terms of service|imprint|legal|legal notice|cookies|cookie settings|cookie policy|accessibility|security|status|licence|license
datenschutz|datenschutzerklärung|agb|impressum|barrierefreiheit|cookie-einstellungen|nutzungsbedingungen
confidentialité|conditions|mentions légales|accessibilité|gestion des cookies
privacidad|condiciones|aviso legal|accesibilidad|configuración de cookies
accept|accept all|accept cookies|reject|reject all|only necessary|manage choices|manage preferences|preferences|settings|got it|ok|agree|i agree|decline|allow all|dismiss|close
alle annehmen|alle akzeptieren|ablehnen|einstellungen|nur notwendige|verstanden|akzeptieren
tout accepter|refuser|tout refuser|paramètres|personnaliser|accepter|continuer sans accepter
aceptar todo|aceptar|rechazar|rechazar todo|opciones|configurar|solo necesarias
copy link|print|save for later|share|share this page|share this|tweet|e-mail|email|like|likes|comments|bookmark|link kopieren|drucken|teilen|später lesen|copier le lien|imprimer|partager|enregistrer|copiar enlace|imprimir|compartir|guardar
subscribe|your e-mail address|your email address|e-mail address|abonnieren|ihre e-mail-adresse|s’abonner|s'abonner|votre adresse e-mail|suscribirse|su correo electrónico|tu correo electrónico|newsletter
back to top|to top|top|nach oben|zum anfang|haut de page|retour en haut|volver arriba|arriba|skip to content|skip to main content|jump to navigation|skip navigation
zum inhalt springen|zur navigation springen|aller au contenu|aller à la navigation|saltar al contenido|ir al contenido|saltar a la navegación|☰|☰ menu|♥|↑|≡|×|✕|⋮
""".strip().replace("\n", "|").split("|"))

# Headings of lists of other pages.
TEASER_HEADS = re.compile(r"""(?ix)^\W*(?:
    on\ this\ page|in\ this\ article|table\ of\ contents|popular\ (?:this\ (?:week|month)|posts|now|articles)|most\ (?:read|popular|viewed|shared)|top\ (?:posts|stories|articles)|trending(?:\ now)?|
    you\ (?:may|might)\ also\ (?:like|enjoy)|keep\ reading|related\ (?:reading|posts|articles|stories|pages|content)|recommended(?:\ for\ you)?|more\ from\ .{1,40}|recent\ (?:posts|articles|comments)|latest\ (?:posts|articles)|
    das\ könnte\ sie\ auch\ interessieren|auf\ dieser\ seite|meistgelesen|mehr\ von\ .{1,40}|weiterlesen|verwandte\ artikel|beliebte\ beiträge|ähnliche\ beiträge|
    à\ lire\ aussi|sur\ cette\ page|les\ plus\ lus|plus\ de\ .{1,40}|articles\ (?:liés|similaires|récents)|
    también\ te\ puede\ interesar|en\ esta\ página|lo\ más\ leído|más\ de\ .{1,40}|artículos\ relacionados|sigue\ leyendo
    )\W*$""")

# Lines of one form that point elsewhere, notices, credits.
LINK_LINES = re.compile(r"""(?ix)^\s*(?:
    (?:←|«|‹|<-|<<)\s*\S.*|(?:previous|next|zurück|weiter|précédent|suivant|anterior|siguiente)\s*(?:→|»|›|:|->)\s*\S.*|\S.*(?:→|»|›)\s*$|
    read\ (?:next|more|also)\s*[:–—-]\s*\S.*|(?:lesen\ sie\ auch|lire\ aussi|lea\ también|leer\ también)\s*:\s*\S.*|
    (?:sponsored|advertisement|advertising|promoted\ by\ [^:]{1,40}|ad|anzeige|werbung|publicité|annonce|publicidad|anuncio|patrocinado|sponsorisé|gesponsert)\s*[:·–—|-]\s+\S.*|
    share\s*(?::|this\b).{0,60}|(?:teilen|partager|compartir)\s*:.{0,60}|\d[\d.,]*\s+(?:likes?|comments?|shares?|views?|claps?|gefällt\ mir|kommentare?|j’aime|commentaires?|me\ gusta|comentarios?)(?:\s*[·|,/]\s*\d[\d.,]*\s+\w+(?:\ \w+)?)*|
    (?:subscribe\ to\ the|abonnieren\ sie\ den|abonnez-vous|suscríbase)\b.{0,60}|join\ [\d.,]+\ readers\b.{0,60}|get\ the\ .{1,30}\ (?:in\ your\ inbox|by\ e-?mail)|like\ what\ you\ read\?.{0,60}|sign\ up\ for\ .{1,60}|
    (?:©|\(c\)|copyright\b).{0,80}|.{0,80}\b(?:all\ rights\ reserved|alle\ rechte\ vorbehalten|tous\ droits\ réservés|todos\ los\ derechos\ reservados)\.?|made\ with\ \w+.{0,30}|powered\ by\ .{1,40}|
    skip\ to\ .{1,30}|jump\ to\ .{1,30}|(?:zum|zur)\ \w+\ springen|aller\ (?:au|à\ la)\ \w+|saltar\ (?:al|a\ la)\ \w+
    )\s*$""")

# Notices about cookies and consent.
NOTICE = re.compile(r"""(?ix)
    \bwe\ (?:and\ our\ partners\ )?(?:use|set|store)\ (?:\w+\ ){0,2}(?:cookies|identifiers)\b|\buses\ cookies\ to\b|\bkeeps?\ identifiers\ to\b|\bstores?\ small\ files\b|\bwith\ your\ consent\ we\b|\bby\ continuing\ you\ agree\b|
    \bsee\ our\ (?:\w+\ )?policy\b|\byou\ can\ change\ your\ (?:choice|mind)\b|\bstrictly\ necessary\.|
    \b(?:verwenden|setzen|nutzen|verwendet|nutzt|setzt)\b.{0,20}\bcookies\b|\bspeichert?\ kennungen\b|\bmehr\ dazu\ in\ der\ datenschutz|\bsie\ können\ dies\ jederzeit\ ändern\b|
    \b(?:utilisons|utilise|déposons|dépose)\b.{0,8}\bcookies\b|\bconserve\ des\ traceurs\b|\bvoir\ notre\ politique\b|\bvous\ pouvez\ changer\ d.avis\b|
    \b(?:usamos|utilizamos|usa|utiliza)\ cookies\b|\bguarda\ identificadores\b|\bpuede\ cambiarlo\ en\ todo\ momento\b|\bconsulte?\ nuestra\ política\b""")
#: A sentence of a notice has no more of a page's own words than this.
NOTICE_LENGTH = 220

#: Share of the best node's points that a sibling with some links must have, labels that can be headings, parts of a line that make it a menu and words of a part.
SIBLING, HEADINGS, MENU_PARTS, PART_WORDS = 0.2, 2, 3, 4
#: A line or a part of one on so many pages of a site, or of so many sites, is a link or a notice.
PAGES, SITES = 3, 3
#: Longer lines are paragraphs, whatever comes again.
UNIT_LENGTH = 300

OWNER = re.compile(r"(?i)^(?:is run by|ist ein angebot|est édité par|es un proyecto|is published by)\b|^(?:studio|collective|guild|press|cooperative|foundation|society|archive|labs?|media|group|team|gmbh|inc\.?|ltd\.?)?\s*(?:\(\d{4}\)|,? \d{4})?\.?$")
SEPARATORS = re.compile(r"\s+[|/·•>›»–]\s+|\s{2,}|\t+")
BULLET = re.compile(r"^\s*[*•\-–‣◦]\s+\S")
NUMBERED = re.compile(r"^\s*\d{1,2}[.)]\s+\S")
SENTENCE_END = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*\s*$")


def parts_of(line: str) -> list[str]:
    """The parts of a line between separators."""
    return [p for p in (p.strip(" |/·•>›») ") for p in SEPARATORS.split(line.strip())) if p]


def unit_of(part: str, site: str) -> str:
    """A line or part with its numbers and the name of its site masked, to be met again on other pages."""
    low = part.lower()
    if site:
        low = low.replace(site, "\x01")
    return re.sub(r"\d[\d.,]*", "0", re.sub(r"\s+", " ", low)).strip()


def units_of(text: str, site: str) -> set[str]:
    """What of a text can come again as chrome: its short lines and their parts, but for list items."""
    out = set()
    for line in text.split("\n"):
        if line.strip() and len(line) <= UNIT_LENGTH and not BULLET.match(line):
            out.add(unit_of(line, site))
            out.update(unit_of(p, site) for p in parts_of(line))
    return out


def link_density(line: str, site: str, again: frozenset[str] | set[str] = frozenset()) -> float:
    """The share of a line that is link text: what comes again on other pages, menus by their form, words of menus and notices."""
    s = line.strip()
    low = s.lower()
    if low in LINK_WORDS or LINK_LINES.match(s) or TEASER_HEADS.match(s):
        return 1.0
    if len(s) <= NOTICE_LENGTH and NOTICE.search(s):
        return 1.0
    if site and low.startswith(site) and OWNER.match(s[len(site):].strip()):
        return 1.0
    if again and len(s) <= UNIT_LENGTH and not BULLET.match(line) and unit_of(s, site) in again:
        return 1.0
    parts = parts_of(s)
    if len(parts) > 1:
        if len(parts) >= MENU_PARTS and not SENTENCE_END.search(s) and all(len(p.split()) <= PART_WORDS for p in parts):
            return 1.0
        if re.search(r"\s[>›»]\s", s) and len(s) < 120 and (parts[0].lower() in LINK_WORDS or unit_of(parts[0], site) in again):
            return 1.0
        return sum(len(p) for p in parts if p.lower() in LINK_WORDS or unit_of(p, site) in again) / max(1, sum(map(len, parts)))
    words = re.split(r"\s+", low)
    return 1.0 if 1 < len(words) <= 6 and all(w in LINK_WORDS for w in words) else 0.0


def kind_of(line: str) -> str:
    """blank, list, number, text (a sentence or more) or label (a heading or a link)."""
    s = line.strip()
    if not s:
        return "blank"
    if BULLET.match(line):
        return "list"
    if NUMBERED.match(line) and not (SENTENCE_END.search(s) and len(s) > 60):
        return "number"
    if len(s) > 160 or (SENTENCE_END.search(s) and len(s.split()) >= 4) or (SENTENCE_END.search(s) and re.search(r"[。！？]", s)):
        return "text"
    return "label"


def points(line: str) -> float:
    """What a paragraph passes to its ancestors: for being one, for its length, its commas and its sentences."""
    s = line.strip()
    return 1 + min(len(s) / 100, 3) + len(re.findall(r"[,，、]", s)) + len(re.findall(r"[.!?](?:\s|$)|。", s))


class Node:
    """A node of the page's tree: page, container (lines between blanks) or block (neighbouring lines of one kind)."""

    def __init__(self, kind: str, parent: Node | None = None):
        self.kind, self.parent, self.opened = kind, parent, ""
        self.children: list[Node] = []
        self.lines: list[int] = []
        self.raw = self.chars = self.links = 0.0
        if parent:
            parent.children.append(self)

    def take(self, i: int, line: str, density: float) -> None:
        """A line: paragraphs pass their points to the block, and half of them to its container; all pass their links up."""
        self.lines.append(i)
        n = len(line.strip())
        node: Node | None = self
        while node is not None:
            node.chars += n
            node.links += n * density
            node = node.parent
        if self.kind == "text":
            self.raw += points(line)
            self.parent.raw += points(line) / 2

    @property
    def density(self) -> float:
        return self.links / max(1.0, self.chars)

    @property
    def score(self) -> float:
        """Points, discounted by link density."""
        return self.raw * (1 - self.density)


def tree_of(lines: list[str], site: str, again: frozenset[str] | set[str] = frozenset(), title: str = "") -> Node:
    """The tree of a chunk's part of a page."""
    kinds = [kind_of(x) for x in lines]
    dense = [link_density(x, site, again) if k != "blank" else 0.0 for x, k in zip(lines, kinds)]
    own = title.strip().lower()
    # how many labels there are from a line on, right before a paragraph or a list of the body; 0 where there is none
    heads = [0] * (len(lines) + 1)
    for i in range(len(lines) - 1, -1, -1):
        if kinds[i] == "label":
            after = kinds[i + 1] if i + 1 < len(lines) else "blank"
            heads[i] = 1 if after == "list" or (after == "text" and dense[i + 1] < 0.5) else heads[i + 1] + 1 if after == "label" and heads[i + 1] else 0
    page = Node("page")
    box: Node | None = None
    now: Node | None = None
    for i, (line, kind, d) in enumerate(zip(lines, kinds, dense)):
        if kind == "blank":
            box = now = None
            continue
        if box is None:
            box, now = Node("container", page), None
        after = kinds[i + 1] if i + 1 < len(lines) else "blank"
        before = kinds[i - 1] if i else "blank"
        s = line.strip()
        teaser = bool(TEASER_HEADS.match(s))
        titled = len(own) > 3 and s.lower() == own
        if kind == "label" and d >= 0.5:
            # words of a menu that head a list or a paragraph; what only comes again may be a heading on many pages
            menu = link_density(line, site) >= 0.5
            if titled or (len(parts_of(line)) == 1 and (after == "list" or (heads[i] == 1 and (teaser or not menu or before == "blank" or dense[i - 1] < 0.5)) or (not menu and 0 < heads[i] <= HEADINGS))):
                d = dense[i] = 0.0
                teaser = False
        form = "title" if titled else "links" if teaser or d >= 0.5 else kind if kind != "number" else "list"
        # titles of other pages below the head of their list; below other links, the last labels before a paragraph are its headings
        if kind in ("label", "number") and form not in ("title", "links") and now is not None and now.kind == "links" and now.opened and (now.opened == "teaser" or not 0 < heads[i] <= HEADINGS):
            form, d = "links", 1.0
        if now is None or now.kind != form:
            now = Node(form, box)
        if teaser or (form == "links" and kind == "label" and not now.opened and len(parts_of(line)) == 1):
            now.opened = "teaser" if teaser else "link"
        now.take(i, line, d)
    return page


def blocks_of(page: Node) -> list[Node]:
    return [b for box in page.children for b in box.children]


def best_score(page: Node) -> float:
    """The points of the best node of the tree."""
    return max((n.score for box in page.children for n in (box, *box.children)), default=0.0)


def judged(page: Node, n_lines: int, best: float) -> list[bool]:
    """For each line whether it is body, against the score of the page's best node."""
    keep = [True] * n_lines
    below: Node | None = None  # the block below, if it is kept
    for b in reversed(blocks_of(page)):
        near = below is not None
        if b.density >= 0.5:
            stays = []
        elif b.kind == "text":
            # siblings of the best node: enough points for their text, or text without any link
            stays = b.lines if b.links == 0 or b.score >= SIBLING * best else []
        elif b.kind == "title":
            stays = b.lines
        elif b.kind == "list":
            stays = b.lines if b.links == 0 or near else []
        else:
            # headings are the last labels before what is kept; a longer run is a menu
            stays = b.lines if near and len(b.lines) <= HEADINGS else b.lines[-1:] if near and below.parent is b.parent else []
        below = b if stays else None
        for i in set(b.lines) - set(stays):
            keep[i] = False
    return keep


def body_lines(text: str, site: str = "", again: frozenset[str] | set[str] = frozenset(), title: str = "", best: float | None = None) -> list[bool]:
    """For each line of `text` whether it is body; blank lines count as body. `best` is the page's best score, if known."""
    lines = text.split("\n")
    page = tree_of(lines, site, again, title)
    return judged(page, len(lines), best_score(page) if best is None else best)


def site_of(url: str | None) -> str:
    """The name of a site in its host: the label before the last."""
    m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", url or "")
    parts = [p for p in (m[1].lower().split(".") if m else []) if p not in ("www", "m", "amp")]
    return parts[-2] if len(parts) > 1 else (parts[0] if parts else "")


SOURCE = "chunk_id string, resource_id string, site string, title string, text string"


def web_chunks(chunks: DataFrame, resources: DataFrame) -> DataFrame:
    """(chunk_id, resource_id, site, title, text) of each web chunk, once."""
    pages = chunks.filter((F.col("source_type") == "webpage") & F.col("text").isNotNull()).select("chunk_id", "resource_id", "title", "text")
    urls = resources.filter("id IS NOT NULL").groupBy(F.col("id").alias("resource_id")).agg(F.min("original_url").alias("url"))
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    labels = F.filter(F.split(host, r"\."), lambda p: (p != "") & ~p.isin("www", "m", "amp"))
    site = F.when(F.size(labels) > 1, F.element_at(labels, F.when(F.size(labels) > 1, -2).otherwise(-1))).when(F.size(labels) == 1, F.element_at(labels, 1)).otherwise("")
    return pages.join(small(urls.select("resource_id", F.coalesce(site, F.lit("")).alias("site"))), "resource_id", "left").select("chunk_id", "resource_id", F.coalesce("site", F.lit("")).alias("site"), "title", "text")


def _digest(unit: str) -> int:
    return int.from_bytes(hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def recurring(src: DataFrame) -> DataFrame:
    """(chunk_id, units): of each chunk the digests of its lines and parts that other pages of its site, or other sites, have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for chunk, page, site, text in zip(*(b.column(c).slice(at, 1000).to_pylist() for c in ("chunk_id", "resource_id", "site", "text"))):
                    for u in units_of(text, site):
                        for column, value in zip(out, (chunk, page if page is not None else chunk, site, _digest(u))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["chunk_id", "resource_id", "site", "unit"])

    units = cut(src.mapInArrow(run, "chunk_id string, resource_id string, site string, unit bigint"))
    # two bounded steps: pages of a site first, so that no unit of all pages comes together
    by_site = units.select("site", "unit", F.xxhash64("resource_id").alias("page")).distinct().groupBy("site", "unit").agg(F.count("*").alias("pages"))
    by_site = by_site.filter("unit IS NOT NULL")
    wide = by_site.groupBy("unit").agg(F.count("*").alias("sites")).filter(F.col("sites") >= SITES).select("unit", F.lit(True).alias("wide"))
    often = cut(by_site.join(wide, "unit", "left").filter((F.col("pages") >= PAGES) | F.col("wide")).select("site", "unit"))
    return units.join(small(often), ["site", "unit"], "left_semi").groupBy("chunk_id").agg(F.collect_set("unit").alias("units"))


class _Again(set):
    """Digests of recurring units, asked by the unit itself."""

    def __contains__(self, unit: object) -> bool:
        return super().__contains__(_digest(unit))  # type: ignore[arg-type]


def _again(units: list[int] | None) -> set:
    return _Again(units) if units else frozenset()


def judged_lines(chunks: DataFrame, resources: DataFrame, bodies: bool) -> DataFrame:
    """With `bodies` (chunk_id, text) of each web chunk, else (chunk_id, line_no) of its lines outside the body.

    A page is the tree of all its chunks: the score of its best node is found over the chunks' parts of the tree first.
    """
    src = cut(web_chunks(chunks, resources).dropDuplicates(["chunk_id"]))
    read = cut(src.join(recurring(src), "chunk_id", "left"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [best_score(tree_of(text.split("\n"), site, _again(units), title or "")) for site, title, text, units in zip(*(b.column(c).to_pylist() for c in ("site", "title", "text", "units")))]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("resource_id"), pa.array(best, pa.float64())], ["chunk_id", "resource_id", "best"])

    own = cut(read.mapInArrow(scores, "chunk_id string, resource_id string, best double"))
    best = own.groupBy("resource_id").agg(F.max("best").alias("page_best"))
    own = own.join(small(best), "resource_id", "left").select("chunk_id", F.coalesce("page_best", "best").alias("best"))
    schema = "chunk_id string, text string" if bodies else "chunk_id string, line_no int"
    kinds = [pa.string(), pa.string() if bodies else pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list] = ([], [])
            for chunk, site, title, text, units, best in zip(*(b.column(c).to_pylist() for c in ("chunk_id", "site", "title", "text", "units", "best"))):
                keep = body_lines(text, site, _again(units), title or "", best)
                if bodies:
                    out[0].append(chunk)
                    kept = "\n".join(x for x, k in zip(text.split("\n"), keep) if k)
                    out[1].append(re.sub(r"\n{3,}", "\n\n", kept).strip("\n"))
                else:
                    for i, k in enumerate(keep, 1):
                        if not k:
                            out[0].append(chunk)
                            out[1].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], schema.replace(",", "").split()[::2])

    return read.join(own, "chunk_id").mapInArrow(run, schema)


def boilerplate(chunks: DataFrame, resources: DataFrame) -> DataFrame:
    """(chunk_id, line_no) of each non-blank line outside the main body."""
    return judged_lines(chunks, resources, False)


def main_bodies(chunks: DataFrame, resources: DataFrame) -> DataFrame:
    """(chunk_id, text): the main body alone."""
    return judged_lines(chunks, resources, True)

"""Template residue and error-page text (problem 10).

Three signs, each over whole texts:

slots    Candidates for a retained variable name, default or blank are found by
         their shape, and the records of one template are aligned through the
         words around them. A place whose fill varies among aligned records is
         a slot, and a candidate standing in it is residue. A candidate that
         stays the same while the rest of its sentence varies is part of the
         sentence: the text only speaks of it.
filler   Runs of filler words, and whole sentences of filler.
pages    Error messages and notices that scripts are needed, as repeated
         whole-page templates: sentences of such messages seed them, the lines of
         a site are learned as the sentences that stand mostly beside seeds, on
         their own or run together with a message, and a text is a page if
         nothing else is in it but a title line.

Shuffled are only candidates with their contexts and hashed sentences with
counts, pre-aggregated on the map side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodiq.session import materialize

_ID = r"[^\W\d_](?:[\w'’]|[ _.\-](?=[^\W\d_]))*"
# fixed values: shapes of variables in common template languages
_STRONG = "|".join(
    (
        rf"\{{\{{\{{?\s*{_ID}\s*\}}?\}}\}}",
        rf"[$#@%]\{{\s*{_ID}\s*\}}",
        rf"%\({_ID}\)s",
        rf"%%{_ID}%%|(?<![\w%])%[^\W\d]\w*%(?![\w%])",
        rf"##{_ID}##|@@{_ID}@@|(?<!\w)__{_ID}__(?!\w)|(?<![\w$])\$[^\W\d]\w*\$(?![\w$])|(?<![\w~])~[^\W\d]\w*~(?!\w)",
        rf"\*\|{_ID}\|\*|\?\?\?{_ID}\?\?\?|!!{_ID}!!|\|\|{_ID}\|\|",
        rf"<<\s*{_ID}\s*>>|&lt;&lt;\s*{_ID}\s*&gt;&gt;",
        rf"\[\[\s*{_ID}\s*\]\]",
        rf"\[(?i:insert|your|enter|add|type)\s[^\[\]\n]{{1,60}}\]|\[[^\[\]\n]{{1,60}}(?i:\shere|to be added|to be completed)\]",
        rf"\{{:\s*{_ID}\s*\}}|\{{\s*{_ID}!\s*\}}",
        rf"<%[=-]?\s*\$?{_ID}\s*-?%>|<\?(?:php\s|=)?\s*\$?{_ID}\s*;?\s*\?>|\{{%\s*{_ID}\s*%\}}",
        r"(?<![\w%])%[sd](?!\w)|\{\d\}",
    )
)
_WEAK = "|".join(
    (
        rf"\{{\s*{_ID}\s*\}}",
        rf"<{_ID}>|&lt;\s*{_ID}\s*&gt;",
        rf"«{_ID}»",
        rf"\[\s*{_ID}\s*\]",
        r"\b[Nn]ull(?:\s[Nn]ull)*\b|\bNULL\b|\bundefined\b|\bNaN\b|<?\bTBD\b>?|\b[Nn]\.?N\.?\b(?=,)|\bX{4,}(?:-X{4})*\b|\bx{4,}\b",
        r"_{4,}|\(\.{4,}\)|\[\s*\]|<\.{2,}>|\[\.{2,}\]|\.{6,}|\((?i:to be completed|to be added|to be announced)\)|-{6,}",
    )
)
_CANDIDATE = re.compile(rf"(?P<strong>{_STRONG})|(?P<weak>{_WEAK})")
_MARKUP = re.compile(r"<(?:a|abbr|b|big|blockquote|body|br|center|cite|code|dd|div|dl|dt|em|font|h\d|head|hr|html|i|img|li|ol|p|pre|q|s|small|span|strike|strong|sub|sup|table|td|th|title|tr|tt|u|ul)>$", re.I)
# what the JVM sends to Python: a superset of the candidates
MAY_HOLD = r"[{<\[«]|&lt;|%\S|##|@@|__|\$\w|~\w|\*\||\?\?\?|!!|\|\||\.{4}|-{6}|(?i)\bnull\b|\bundefined\b|\bnan\b|\btbd\b|x{4}|\bn\.?n\.?,|to be (?:completed|added|announced)"
SENTENCE = r"\n+|(?<=[.!?…])\s+"
_WORD = re.compile(r"◦|\w+|[^\w\s]")
# fixed values: labels of blank forms stand before a colon
_BLANK_LINE = re.compile(rf"^[^:\n]{{1,40}}:\s*(?:{_WEAK}|{_STRONG})\s*$")


def _contexts(sentence: str) -> Iterator[tuple[str, bool, str, str, str, str]]:
    """(fill, strong, both sides, left, right, near) of every candidate of a sentence."""
    found = [m for m in _CANDIDATE.finditer(sentence) if not _MARKUP.match(m.group())]
    if not found:
        return
    marked, at = [], 0
    for m in found:
        marked += [sentence[at : m.start()], " ◦ "]
        at = m.end()
    marked.append(sentence[at:])
    words = [re.sub(r"\d+", "0", w.lower()) for w in _WORD.findall("".join(marked))]
    places = [i for i, w in enumerate(words) if w == "◦"]
    padded = ["^", "^", *words, "$", "$"]
    for m, i in zip(found, places, strict=False):
        left, right = padded[i : i + 2], padded[i + 3 : i + 5]
        l2, r2 = " ".join(left), " ".join(right)
        yield m.group(), m.group("strong") is not None, f"a {l2} ◦ {r2}", f"l {l2}", f"r {r2}", f"n {left[1]} ◦ {right[0]}"


def slot_candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence hash, fill, strong, four contexts) of every candidate."""
    kind = docs.schema[key].dataType.simpleString()
    split = re.compile(SENTENCE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["_key"].tolist(), pdf["_text"].tolist(), strict=True):
                if "◦" in t:
                    t = t.replace("◦", "o")
                for s in split.split(t):
                    rows.extend((k, re.sub(r"\d+", "0", s), *c) for c in _contexts(s))
            yield pd.DataFrame(rows, columns=["_key", "sentence", "fill", "strong", "c_both", "c_left", "c_right", "c_near"])

    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").rlike(MAY_HOLD))
    out = d.mapInPandas(run, f"_key {kind}, sentence string, fill string, strong boolean, c_both string, c_left string, c_right string, c_near string")
    return out.withColumn("sentence", F.xxhash64("sentence"))


def unfilled_slots(docs: DataFrame, key: str, text: str, literal_from: int = 3) -> DataFrame:
    """Keys of texts with a candidate in an induced slot."""
    c = materialize(slot_candidates(docs, key, text))
    ctx = c.select("fill", "sentence", F.explode(F.array("c_both", "c_left", "c_right", "c_near")).alias("context")).groupBy("context").agg(
        (F.min("fill") != F.max("fill")).alias("varies"), F.count_distinct("sentence").alias("sentences")
    )
    ctx = materialize(ctx)
    d = c
    for name in ("both", "left", "right", "near"):
        side = ctx.select(F.col("context").alias(f"c_{name}"), F.col("varies").alias(f"v_{name}"), F.col("sentences").alias(f"n_{name}"))
        d = d.join(side, f"c_{name}")
    slot = F.col("v_both") | F.col("v_near") | (F.col("v_left") & F.col("v_right"))
    literal = (~F.col("v_left") & (F.col("n_left") >= literal_from)) | (~F.col("v_right") & (F.col("n_right") >= literal_from))
    # too few aligned records to tell: the shape decides
    return d.where(slot | (F.col("strong") & ~literal)).select("_key").distinct()


# fixed values: words of the usual filler texts
_LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua "
    "enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure "
    "reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia "
    "deserunt mollit anim laborum pellentesque vestibulum curabitur facilisi lacinia porttitor sagittis ultrices ornare suspendisse vivamus mauris "
    "fermentum nunc vel nec non quam erat eget morbi nullam etiam praesent donec cras proin integer aenean phasellus maecenas fusce viverra lectus"
).split()
LATIN_RUN = rf"(?i)\blorem\s+ipsum(?:[\s,.]+(?:{'|'.join(_LATIN)})\b){{3,}}|\b(?:(?:{'|'.join(w for w in _LATIN if len(w) > 2)})[\s,.]+){{5,}}"
# fixed values: sentences of filler in the languages of the corpus
_FILLER = (
    r"(?:.{0,30}\b(?:sample|dummy|filler|placeholder|demo|default|blind) (?:text|copy|paragraph|content|theme)\b[^.!?]{0,50}"
    r"|.{0,30}\b(?:text|copy|content|image|title) placeholder\b"
    r"|.{0,20}\b(?:your|the) (?:content|text|title|description|message|abstract)s? (?:goes?|comes?|belongs?) here\b"
    r"|(?:please )?(?:add|enter|insert|write|type|put) (?:a|your|the|some) [^\"“«]{0,40}\b(?:here|in this (?:box|field|area))\b"
    r"|.{0,40}\breplace (?:it|this|me) with your own\b[^.!?]{0,12}"
    r"|.{0,20}\btextes? de remplissage\b[^.!?]{0,40}|.{0,20}\btexto (?:de relleno|simulado|de ejemplo)\b[^.!?]{0,40}"
    r"|.{0,20}\b(?:blindtext|platzhaltertext|beispieltext|fülltext|mustertext)\b[^.!?]{0,40}"
    r"|(?:votre|su|ihr) (?:contenu|texte|contenido|texto|inhalt|text) [^.!?]{0,15}\b(?:ici|aquí|hier)\b)"
)
FILLER = rf"(?i)^{_FILLER}(?:[\W_]+{_FILLER})*[\W_]*$"
FILLER_RUN = (
    r"(?i)(?:^|[\s.])(?:(?:blah|test|text|asdf|qwer|foo|bar|x{3,})\s+){3,}(?:blah|test|text|asdf|qwer|foo|bar|x{3,})\b"
    r"|(?:^|[\s.])(blah|test|text|asdf)\s+\1\s+\1\b|\b(\p{L}{2,12})(?:\s+\2\b){3,}"
)
_SAID = r"[\"“”„«»]"
_JS = r"(?:java ?script|\bjs\b|\bscripts?\b|\bscripting\b)"
# fixed values: wording of error messages, script notices and page furniture in the languages of the corpus
_ERROR = (
    r"(?:http |error |erreur |fehler )?\b[45]\d\d\b[ :\-–—]*(?:forbidden|not found|unauthori[sz]ed|internal server error|bad gateway|bad request|service (?:temporarily )?unavailable|gateway time-?out|too many requests"
    r"|(?:the )?page (?:you requested )?(?:could not be found|cannot be found|not found)|(?:die )?(?:angeforderte )?seite (?:nicht gefunden|existiert nicht|wurde nicht gefunden)"
    r"|(?:la )?página (?:solicitada )?(?:no encontrada|no existe)|(?:la )?page (?:introuvable|demandée (?:n[’']existe pas|est introuvable)))"
    r"|access denied|accès refusé|zugriff verweigert|acceso denegado|\bforbidden\b"
    r"|internal server error|interner serverfehler|erreur interne du serveur|error interno del servidor"
    r"|(?:the )?service (?:is )?temporarily unavailable|service momentanément indisponible|der dienst ist vorübergehend nicht erreichbar|servicio no disponible temporalmente"
    r"|this site is down for (?:scheduled )?maintenance|site en maintenance|wegen wartungsarbeiten nicht verfügbar|sitio en mantenimiento|under construction(?: - come back soon)?|we will be back shortly"
    r"|error establishing a database connection|connexion à la base de données impossible|verbindung zur datenbank fehlgeschlagen|no se pudo conectar con la base de datos"
    r"|(?:sqlstate\[|warning: \w+\(|fatal error|parse error|traceback \(most recent|uncaught \w*(?:error|exception)|java\.[\w.]+exception)[^\n]*?(?=\.\s|\n|(?:reference #|request id|try again|home \||go back|nginx|apache|we apolog|if the problem)|$)"
    r"|dns lookup failed(?: for the requested name)?|the connection (?:to [\w. ]{1,40} )?was reset|upstream request timeout|(?:the )?request timed out|this site can[’']t be reached"
    r"|this domain (?:name )?(?:has expired|is for sale|is parked)|the account for this site has been suspended"
    r"|(?:your session has expired|votre session a expiré|ihre sitzung ist abgelaufen|su sesión ha caducado)(?:, (?:veuillez vous reconnecter|inicie sesión de nuevo))?"
    r"|too many requests|rate limit exceeded(?:, retry after \d+ s)?|please slow down and try again in \d+ seconds|invalid security token|index of /[\w/]*(?: - parent directory)?"
    r"|something went wrong(?: on our (?:side|end))?|the server encountered an (?:unexpected condition|internal error)"
    r"|you do not have permission to (?:view|access) this (?:resource|page)(?: on this server)?|you must be (?:signed|logged) in to continue|please (?:sign|log) in again|bitte melden sie sich erneut an"
    r"|please prove that you are (?:a )?human|complete the security check(?: to go on)?|checking your browser(?: before you continue)?|(?:the page you requested could not be found|page introuvable|seite nicht gefunden|página no encontrada|page not found)"
)
_NOTICE = (
    rf"(?:you need to|you must|please|kindly|this (?:site|page|app|application)|your browser|java ?script (?:is|seems|must|est|ist|está)|the (?:reading platform|article viewer|site|page)\b(?! of)|noscript|"
    rf"bitte|diese (?:anwendung|seite)|ce site|cette (?:page|application)|veuillez|este sitio|esta (?:página|aplicación)|active|habilite|use a current|allow|enable|activate|turn on|switch)\b(?=[^.!?\n]{{0,90}}{_JS})(?![^.!?\n]{{0,90}}\d{{4}})[^.!?\n©]{{0,100}}"
    rf"|(?:cookies and )?scripts are (?:blocked|disabled|turned off|switched off)"
    rf"|java ?script (?:is|seems|est|ist|está)[^.!?\n©]{{0,70}}(?:off|disabled|désactivé|deaktiviert|desactivado)[^.!?\n©]{{0,40}}"
)
# what any site has, a bar of links included; a site's own lines are learned beside the seeds
_FURNITURE = r"\breload\b|\bloading\b|\bnginx\b|apache server at port \d+|request id: [\d-]+|reference #[\d.]+|(?:fehler|error )?(?:code|código|fehlercode) ?: ?\d+|©[^\n]*|(?:\p{L}+(?: \p{L}+)? ?[|·•»] ?){2,}\p{L}+"
# every wording begins a word, so the alternatives are tried at word starts only
MESSAGE = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_ERROR}|{_NOTICE})"
PAGE_PART = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_ERROR}|{_NOTICE}|{_FURNITURE})"
# every wording of _ERROR and _NOTICE holds one of these, so a text without any is not taken apart for them
MESSAGE_WORDS = (
    "script", "js", "forbidden", "unauthori", "denied", "refusé", "verweigert", "denegado", "server error", "serverfehler", "erreur interne", "error interno", "bad gateway", "bad request",
    "unavailable", "gateway time", "too many", "be found", "not found", "nicht gefunden", "existiert nicht", "no encontrada", "no existe", "introuvable", "existe pas", "indisponible",
    "nicht erreichbar", "no disponible", "maintenance", "wartungsarbeiten", "nicht verfügbar", "mantenimiento", "under construction", "back shortly", "database connection", "base de données",
    "datenbank", "base de datos", "sqlstate", "warning:", "fatal error", "parse error", "traceback", "uncaught", "java.", "dns lookup", "was reset", "timeout", "timed out", "be reached",
    "domain", "suspended", "session has expired", "session a expiré", "sitzung", "sesión", "rate limit", "slow down", "security token", "index of /", "went wrong", "server encountered",
    "permission", "logged in", "signed in", "sign in", "log in", "melden sie sich", "human", "security check", "your browser",
)
COVERED = r"^[§\W\d_]*$"
TITLED = r"^[^§\n]{3,160}§[§\W\d_]*$"


# likewise every wording of _FILLER
FILLER_WORDS = (
    "sample", "dummy", "filler", "placeholder", "demo", "default", "blind", "here", "in this", "your own", "remplissage", "relleno", "simulado", "ejemplo", "platzhalter", "beispieltext", "fülltext", "mustertext", "ici", "aquí", "hier",
)


def _holds(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def _signature(c: Column) -> Column:
    """A sentence whatever its case, numbers and the marks around it."""
    return F.xxhash64(F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\W\d_]+|[\W\d_]+$", "")), r"\d+", "0"))


def _page_parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences with their place, hash and signs; rest is what messages and furniture leave of a sentence."""
    s = F.posexplode(F.split(F.col("_text"), SENTENCE)).alias("pos", "s")
    d = docs.select(F.col(key).alias("_key"), F.replace(F.col(text), F.lit("§"), F.lit("S")).alias("_text"), _holds(F.lower(text), MESSAGE_WORDS).alias("_hinted")).select("_key", "_hinted", s).where(F.col("s").rlike(r"\w"))
    may = F.col("_hinted") & F.col("s").rlike(MESSAGE)
    d = d.withColumn("rest", F.when(may, F.regexp_replace("s", PAGE_PART, "§")))
    head = F.regexp_replace("rest", r"§[\s\S]*$", "")
    capital = F.regexp_count(head, F.lit(r"(?<!\p{L})\p{Lu}")) >= F.regexp_count(head, F.lit(r"(?<!\p{L})\p{Ll}\p{L}{3,}"))
    covered = F.coalesce(F.col("rest").rlike(COVERED), F.lit(False))
    shown = F.trim(F.coalesce(F.when(F.col("rest").rlike(TITLED), head), F.col("s")))
    return d.select(
        "_key",
        "pos",
        _signature(F.col("s")).alias("sig"),
        F.col("rest").isNotNull().alias("told"),
        # what follows the message in its sentence, if nothing or a title stands in front
        F.when(F.col("rest").isNotNull() & (~head.rlike(r"\p{L}") | (capital & (F.length(head) <= 160))), _signature(F.regexp_replace(F.regexp_replace("rest", r"^[^§]*§", ""), r"[§\s]+", " "))).alias("sig_left"),
        (covered | F.coalesce(F.col("rest").rlike(TITLED) & capital, F.lit(False))).alias("seed"),
        covered.alias("whole"),
        (F.col("_hinted") & F.col("s").rlike(rf"(?i)^(?:[\s.!?]*(?:{_FURNITURE}))+[\s.!?]*$")).alias("furniture"),
        ((_holds(F.lower("s"), FILLER_WORDS) & F.col("s").rlike(FILLER) & ~F.col("s").rlike(_SAID)) | F.col("s").rlike(FILLER_RUN)).alias("filler"),
        F.when(F.col("_hinted"), F.size(F.split(shown, r"\s+"))).otherwise(0).alias("words"),
        (F.col("_hinted") & ((F.size(F.split(shown, r"\s+")) <= 6) | (F.regexp_count(shown, F.lit(r"(?<!\p{L})\p{Lu}")) >= F.regexp_count(shown, F.lit(r"(?<!\p{L})\p{Ll}\p{L}{3,}"))))).alias("titular"),
    )


def message_pages(parts: DataFrame, furniture_share: float = 0.5) -> DataFrame:
    """Keys of texts that consist of messages, their furniture and at most a leading title."""
    told = parts.where("told").select("_key").distinct()
    near = parts.join(told, "_key", "left_semi")
    seeded = near.join(near.where("seed").select("_key").distinct(), "_key", "left_semi")
    beside = seeded.groupBy("sig").agg(F.count_distinct("_key").alias("n_beside"))
    overall = parts.join(beside.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.count_distinct("_key").alias("n"))
    learned = materialize(beside.join(overall, "sig").where((F.col("n") > 1) & (F.col("n_beside") >= furniture_share * F.col("n"))).select("sig", F.lit(True).alias("page")))
    # a message that runs into a line of the site without a stop is one sentence with it
    marked = near.join(learned, "sig", "left").join(learned.select(F.col("sig").alias("sig_left"), F.col("page").alias("joined")), "sig_left", "left")
    marked = marked.withColumn("ends", F.coalesce("joined", F.lit(False))).withColumn("other", F.col("page").isNull() & ~F.col("whole") & ~F.col("furniture") & ~F.col("ends"))
    return (
        marked.groupBy("_key")
        .agg(
            F.max(F.col("seed") | F.col("ends")).alias("has_seed"),
            F.count_if("other").alias("others"),
            F.max(F.when(F.col("other"), F.col("pos"))).alias("title_end"),
            F.min("pos").alias("start"),
            F.sum(F.when(F.col("other"), F.col("words"))).alias("title_words"),
            F.count_if(F.col("other") & ~F.col("titular")).alias("spoken"),
        )
        .where("has_seed")
        # a title may be cut at its abbreviations, so it is all that stands in front
        .where("others = 0 or (spoken = 0 and title_words <= 16 and title_end - start < others)")
        .select("_key")
    )


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reason) of the texts that are or hold template residue.

    reason is one of slot, filler, form, page; a text may have several. Null and
    empty texts are no case. Repeated texts are found as often as they come,
    and copies do not make a candidate look like a fixed part of a sentence,
    since distinct sentences are counted. Other columns are not looked at. An
    empty table gives no rows. Rows with a null key are left out.
    """
    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null and _text is not null")
    parts = materialize(_page_parts(d, "_key", "_text"))
    lines = F.filter(F.split("_text", r"\n+"), lambda x: F.trim(x) != "")
    form_line = r"^\s*[^:\n]{1,40}:\s*(?:\[\s*\]|_{3,}|\.{3,}|<\.{2,}>|\(?(?i:tbd|to be completed|to be added|xxxx+|n/?a)\)?|-{3,})[\s.]*$"
    forms = d.where((F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(form_line))).select("_key", F.lit("form").alias("reason"))
    latin = d.where(F.col("_text").rlike(LATIN_RUN)).select("_key", F.lit("filler").alias("reason"))
    out = (
        unfilled_slots(d, "_key", "_text").select("_key", F.lit("slot").alias("reason"))
        .unionByName(parts.where("filler").select("_key", F.lit("filler").alias("reason")))
        .unionByName(latin)
        .unionByName(forms)
        .unionByName(message_pages(parts).select("_key", F.lit("page").alias("reason")))
    )
    return out.distinct().withColumnRenamed("_key", key)

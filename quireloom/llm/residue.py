"""Problem 9: template residue, filler, error pages and demands to enable scripts.

Every line of a document is reduced to a normal form in which numbers, addresses, dates and names are masked, and the
hashes of these forms are grouped over the corpus: in how many documents and sources a form occurs. The groups are
classified: by phrases that only messages, demands and filler have; widely recurring ones also by what notices of any
wording have, words for the machinery of a site with a failure or an address to the reader; and widely recurring short
ones at the edges of documents as page furniture. A document goes when the lines left of it, its body, are of such
groups. A placeholder counts wherever it stands, unless the text quotes it as an example.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash

try:
    import ahocorasick
except ImportError:  # the same result by trying every part
    ahocorasick = None
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.plans.staging import stage
from quireloom.sources import read_table

#: Documents and sources in which a form must occur to recur widely, as a notice and as page furniture.
NOTICE_DOCUMENTS, NOTICE_SOURCES = 3, 2
FURNITURE_DOCUMENTS, FURNITURE_SOURCES = 5, 3
#: Furniture is a line of a few characters without an end, among so many lines from the start or end of a document.
FURNITURE_CHARS, EDGE_LINES = 60, 4
#: Share of a body's characters that must be residue. Filler may have one sentence of real text over it.
WHOLE = 0.9
#: Words of a line from which on it must hold a function word to be language.
FILLER_WORDS = 8

# Forms of unfilled placeholders.
PLACEHOLDERS = r"""
\{\{[^{}\n]{1,60}\}\}
\{%[^%{}\n]{1,60}%\}
\$\{[^{}\n]{1,60}\}
\#\{[^{}\n]{1,60}\}
<%=?[^%<>\n]{1,60}%>
<<[^<>\n]{1,60}>>
%\([A-Za-z_][A-Za-z_0-9]*\)[sdfr]
(?<![A-Za-z0-9_%])%[sd](?![A-Za-z0-9_])
(?<![A-Za-z0-9_%])%[A-Z][A-Z_]{2,}%(?![A-Za-z0-9_%])
\$\$?[A-Z][A-Z_]{2,}\$\$?
@@[A-Z_]{2,}@@
(?<![A-Za-z0-9_])__[A-Z][A-Z_]{1,}__(?![A-Za-z0-9_])
_{3,}\ ?\([A-Za-z_ ]{2,40}\)
\[(?i:insert|your|enter|add|type)[^\[\]\n]{1,40}\]
\((?i:insert|enter|add|type)\ [A-Za-z_]{2,30}\)
[「（【［\[(](?:请|此处|在此)?(?:输入|填写|插入)[^「」（）【】［］\[\]()\n]{1,20}[」）】］\])]
[「（【［\[(][^「」（）【】［］\[\]()\n]{1,20}(?:を入力|をここに)[」）】］\])]
\[[^\[\]\n]{1,40}(?i:\ goes\ here|\ here)\]
(?<![A-Za-z0-9_{,])\{\d{1,2}\}(?![A-Za-z0-9_,])
(?i:x{4}年x{2}月x{2}日)
"""

# Names of fields that stand in angle or square brackets for what is to be filled in.
FIELD_NAMES = (
    "address author authors blurb book_title chapter chapter_title city company copyright country customer date "
    "dedication description edition editor email epigraph first_name illustrator isbn language last_name name "
    "number page phone place price publisher reader recipient sender series signature subject subtitle surname "
    "text title translator url user username year"
)

# What error pages, refusals of access and failing services say.
MESSAGES = r"""
\b(?:not\ found|page\ not\ found|bad\ gateway|internal\ (?:server\ )?error|service\ (?:temporarily\ )?unavailable|gateway\ time-?out|forbidden|unauthori[sz]ed)\b
\b(?:access|permission)\ denied\b
\bdo\ not\ have\ permission\b
\b(?:error|http|status|code|fault)\b\W{0,3}\d{3,4}\b
\bsession\ has\ expired\b
\bsign\ in\ again\b
\btoo\ many\ requests\b
\btimed\ out\b
\bdid\ not\ answer\ in\ time\b
\b(?:could|can)\ ?not\ (?:be\ loaded|connect\ to|be\ reached)\b
\b(?:refused|lost)\ the\ connection\b
\bunknown\ (?:fault|error)\b
\bdown\ for\ (?:repairs|maintenance)\b
\bcarrying\ out\ maintenance\b
\b(?:has\ been\ moved|does\ not\ exist\ any\ ?more|no\ longer\ exists)\b
\bonly\ open\ to\ members\b
\bnot\ available\ in\ your\ (?:region|country)\b
\b(?:something|anything)\ went\ wrong\ on\ our\ side\b
\b(?:we|our\ team|the\ team)\ (?:\w+\ ){0,4}(?:have|has|had)\ been\ (?:told|notified|informed|alerted)\b
\b(?:we|our\ team|the\ team|our\ engineers)\ (?:are|is)\ (?:looking\ into|working\ on)\ (?:it|this|the\ problem)\b
\btry\ again\ (?:later|in\ \d+)
\bplease\ reload\b
\bgo\ back\ to\ the\ start\ page\b
\bif\ this\ happens\ again\b
\b(?:write\ to|contact|call|ask)\ (?:the\ |our\ )?(?:help\ ?desk|support|webmaster|administrator)\b
\b(?:and|then|please|must)\ reload\b|\breload\ (?:the|this)\ page\b
\b(?:checking|check|verify|verifying|prove|confirm)\ (?:that\ |if\ )?you\ are\ (?:not\ a\ robot|(?:a\ )?human)\b
\b(?:takes|take|within|in)\ a\ few\ seconds\b
\bwe(?:'ll|\ will)\ be\ back\b
\btraceback\ \(most\ recent
\bfile\ ".{1,120}",\ line\ \d+
^\s*\w*(?:error|exception):
\bfailed\ to\ open\ stream\b
\bfatal\ error\b
\bquota\b.{0,20}\bused\ up\b
"error"\s*:
\brequested\ (?:chapter|page|url|file)\b.{0,40}\b(?:not\ found|does\ not\ exist)\b
\bpage\ introuvable\b
\bn'existe\ plus\b
\berreur\ (?:interne|\d{3})
\bseite\ nicht\ gefunden\b
\bprüfen\ sie\ die\ adresse\b
\bzugriff\ verweigert\b
\bno\ se\ encontró\ la\ página\b
\bacceso\ denegado\b
页面不存在
(?:无法|未能)(?:访问|打开|找到|连接)(?:该|此|本|您)?(?:页|站|服务|资源)
服务器(?:繁忙|错误|内部错误|暂时)
请稍后(?:再试|重试)
错误代码
(?:没有|无)权限
(?:已|被)(?:删除|移除)或(?:移动|不存在)
ページは?が?見つかりません
見つかりませんでした
アクセスが拒否
しばらくしてから
サーバーエラー
"""

# What pages say that show nothing without scripts.
DEMANDS = r"""
\b(?:enable|activate|allow|permit|turn\ on|switch\ on)\b.{0,30}\b(?:javascript|scripts?|scripting)\b
\b(?:javascript|scripts?|scripting)\b.{0,40}\b(?:required|disabled|is\ off|turned\ off|blocked|needed)\b
\b(?:without|needs?|requires?)\ (?:javascript|scripts?)\b
\bscript\ block(?:ing|er)\b
\b(?:switch|turn)\ (?:it|them|this)\ (?:back\ )?on\b
\bbrowser\b.{0,30}\bscripts?\b
\bcannot\ be\ (?:shown|displayed)\b
\baktivieren\ sie\ javascript\b
\bjavascript\ (?:ist|muss)\b
\bnécessite\ javascript\b
\bactivez\ javascript\b
\bejecución\ de\ scripts\b
\b(?:active|habilite)\ javascript\b
(?:启用|打开|开启)\s*(?:脚本|javascript)
(?:需要|未)启用\s*(?:脚本|javascript)
(?:スクリプト|javascript)を有効
"""

# Texts that hold the place of a real text.
FILLERS = r"""
\b(?:lorem\ ipsum|dolor\ sit\ amet)\b
\b(?:placeholder|dummy|filler|sample|body)\ (?:text|body|copy|paragraph)\b
\b(?:sed\ do\ eiusmod|ut\ enim\ ad\ minim|duis\ aute\ irure|excepteur\ sint|consectetur\ adipisci)
\breplace\ this\ text\b
\btype\ the\ (?:chapter|text)\ here\b
\byour\ (?:story|text|content)\ (?:starts|goes)\ here\b
\bclick\ to\ edit\b
\basdf\b
\bfaux\ texte\b
\btext\ text\ text\b
\bplatzhaltertext\b|\bblindtext\b
\btexto\ de\ (?:relleno|ejemplo|muestra)\b
占位(?:文本|文字|内容)
示例文字
请替换为正式内容
上线前请删除
(?:ダミーテキスト|仮のテキスト|サンプルテキスト)
"""


def _any(patterns: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns.strip().splitlines()), re.I | re.S)


_FIELDS = "|".join(FIELD_NAMES.split())
_PLACEHOLDER = re.compile(
    "|".join(p.replace("\\ ", " ") for p in PLACEHOLDERS.strip().splitlines())
    + rf"|<(?:{_FIELDS})>|<(?:{_FIELDS.upper()})>|\[(?:{_FIELDS})\]|\[(?:{_FIELDS.upper()})\]"
)
_PLACEHOLDER_HINT = re.compile(r"[{}<>%$@\[\]]|输入|填写|插入|入力|をここに|__|[xX]{4}|\((?i:insert|enter|add|type) ")
_MESSAGE, _DEMAND, _FILLER = _any(MESSAGES), _any(DEMANDS), _any(FILLERS)
_X_FILLER = re.compile(r"^[\W_]*(?:x+[\W_]+){2,}x*[\W_]*$", re.I)
_X_HINT = re.compile(r"(?<![^\W_])x+[\W_]")  # stands in whatever _X_FILLER matches
_EXAMPLE = re.compile(r"“[^”\n]*”|「[^」\n]*」|『[^』\n]*』|`[^`\n]*`|«[^»\n]*»|„[^“\n]*“|\"[^\"\n]*\"|‘[^’\n]*’")
_SENTENCE = re.compile(r"[^。！？!?.\n]*(?:[。！？!?]|\.(?!\w))+[”’\"')\]）」]*\s*|[^\n]+?(?=\n|\Z)|\n+")
_WORDS = re.compile(r"[^\W\d_]+")


def has_placeholder(text: str) -> bool:
    """Whether a placeholder stands unfilled and is not quoted."""
    if not _PLACEHOLDER_HINT.search(text):
        return False
    spans = None
    for found in _PLACEHOLDER.finditer(text):
        if spans is None:
            spans = [m.span() for m in _EXAMPLE.finditer(text)]
        if not any(a < found.start() and found.end() < b for a, b in spans):
            return True
    return False


_MASKS = (
    (re.compile(r"\b(?:https?://|www\.)\S+|\S+@\S+\.\w+"), "U"),
    (re.compile(r"\d+(?:[.,:/-]\d+)*"), "0"),
    (re.compile(r"\b[A-ZÀ-Þ][\w'’-]*(?: (?:of |the |de )?[A-ZÀ-Þ][\w'’-]*)*"), "N"),
    (re.compile(r"\s+"), " "),
)


def masked(line: str) -> str:
    """Normal form of a line: addresses, numbers, dates and runs of capitalised words masked."""
    first, rest = line[:1], line[1:]
    out = first + rest
    for pattern, mask in _MASKS:
        out = pattern.sub(mask, out)
    return out.strip().casefold()


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(masked(line)) - (1 << 63)


#: In a sentence that tells what somebody said, a message is part of the story.
_STORY = re.compile(
    r"\b(?:said|says|replied|wrote|answered|sagte|dit|dijo|disse)\b|(?<!you )\basked\b|\btold (?:him|her|them|me|us)\b|说道|答道|写道", re.I
)


def kind_of(sentence: str) -> str | None:
    """Message, demand or filler, as the phrase rules have it."""
    if _STORY.search(sentence):
        return None
    if _DEMAND.search(sentence):
        return "demand"
    if _MESSAGE.search(sentence):
        return "message"
    if _FILLER.search(sentence) or _X_FILLER.match(sentence):
        return "filler"
    return None


# Small words without which no sentence of these languages gets by.
FUNCTION_WORDS = frozenset(
    "the a an of and to in is was for on that with as at by it be are had from or not he she they we you your its his her "
    "der die das und ein eine mit von zu im den dem des nicht ist war auf für sie er es als nach über "
    "le la les un une et de du des en dans pour que qui ne pas sur est au aux il elle "
    "el los las y del con por no una su se es al lo como o "
    "il lo gli i e di da che non per con una sono era alla nel della dei "
    "os as um uma do da dos na em com para foi não mais "
    "het een van op te dat niet zijn voor met aan ook naar maar "
    "och att det som på är av för inte den till har med og er ikke til af på å "
    "ja on ei se että oli ovat mutta kun hän ole "
    "i w z na do nie to jest się że po od za jak ale był "
    "a v na se je že do ale jako si bylo pro od "
    "az és hogy nem egy is volt meg csak mint "
    "ve bir bu da de için ile çok ama gibi "
    "şi nu cu la pe din este un sau mai care "
    "yang dan di ini itu untuk dari dengan pada tidak akan juga oleh ke "
    "và của là có không được cho một các trong "
    "ad cum sed qui quae quod ut si ex ab per pro atque nec".split()
)
_NOT_PLAIN = re.compile(r"[^\x00-\x7f‘’“”—–…·]|\d")


def _is_babble(sentence: str) -> bool:
    """Many small-lettered plain words and none without which no sentence of the listed languages gets by."""
    if _NOT_PLAIN.search(sentence):
        return False
    words = _WORDS.findall(sentence)
    return (
        len(words) >= FILLER_WORDS
        and sum(w[0].islower() for w in words) >= 0.75 * len(words)
        and FUNCTION_WORDS.isdisjoint(w.lower() for w in words)
    )


# The machinery of a site, what it shows, that it fails, and that it speaks to its reader, in several languages.
SYSTEM = (
    r"\b(?:servers?|servidor|serveur|serveurs|browsers?|navigateur|navegador|website|web\ ?site|webseite|site|sito|sitio|url|"
    r"links?|lien|enlace|java ?scripts?|scripts?|cookies?|log ?in|sign ?in|anmeld\w*|connexion|connection|conexión|connessione|"
    r"verbindung|network|netzwerk|réseau|rete|session|sitzung|sessione|sesión|cache|https?|database|datenbank)\b|"
    r"服务器|浏览器|网络|网址|链接|网站|登录|会话|サーバー|ブラウザ|ネットワーク|リンク|サイト|ログイン|서버|브라우저|сервер|браузер|сайт"
)
PLACES = r"\b(?:page|seite|pagina|página|content|inhalt|contenu|contenuto|contenido|resource|file|document)\b|页面|内容|文件|ページ|페이지|страниц"
FAILURES = (
    r"\b(?:not\ available|unavailable|fail(?:s|ed|ure)?|errors?|problems?|wrong|expired|missing|(?:not|n't)\ (?:be\ )?(?:found|find|exist|load|open|reach)\w*|"
    r"blocked|denied|offline|timed?\ ?out|fehler\w*|nicht\ (?:gefunden|verfügbar|erreichbar|geladen|möglich)|fehlgeschlagen|abgelaufen|"
    r"erreur|introuvable|indisponible|échou\w*|expiré\w*|errore|non\ (?:è\ )?(?:disponibile|trovat\w+|raggiungibile|esiste)|impossibile|scadut\w+|"
    r"no\ (?:está\ )?(?:disponible|encontrad\w+|existe)|não\ (?:está\ )?(?:disponível|encontrad\w+|existe)|erro|falló|caducad\w+)\b|"
    r"错误|失败|无法|不存在|不可用|超时|过期|エラー|失敗|できません|見つかりません|오류|ошибка|не\ найден"
)
ADDRESSES = (
    r"\b(?:you|your|please|sorry|oops|try|retry|reload|refresh|click|go\ back|return\ to|contact|bitte|ihre?n?|klicken|versuchen|entschuldigung|"
    r"veuillez|vous|votre|désolés?|réessayez|cliquez|per\ favore|riprov\w+|prego|siamo\ spiacenti|torna|clicca|verific\w+|"
    r"por\ favor|inténtelo|intente|disculpe|lo\ sentimos|haga\ clic|vuelva|tente|desculpe|probeer|alstublieft)\b|"
    r"请|您|抱歉|对不起|刷新|返回|ください|申し訳|再読み込み|다시|죄송|пожалуйста|извините|попробуйте"
)
_NOTICE = tuple(re.compile(p, re.I) for p in (SYSTEM, PLACES, FAILURES, ADDRESSES))


# Parts of words, at least one of which stands in whatever SYSTEM or PLACES match.
SITE_HINTS = tuple(
    "serv|browser|naveg|navig|web|site| sito|sito |sitio|url|link|lien|enlace|script|cookie|log in|login|sign in|signin|anmeld|connex|connec|"
    "conex|connes|verbindung|netw|netz|réseau|rete|sess|sitzung|sesi|cache|http|databa|datenb|page|seite|pagin|página|"
    "content|inhalt|conten|resource|file|document|服务器|浏览器|网络|网址|链接|网站|登录|会话|页面|内容|文件|サーバー|"
    "ブラウザ|ネットワーク|リンク|サイト|ログイン|ページ|서버|브라우저|페이지|сервер|браузер|сайт|страниц".split("|")
)


class _Parts:
    """Whether one of many parts of words stands in a text."""

    def __init__(self, parts: tuple[str, ...]):
        self.parts, self.machine = parts, None
        if ahocorasick:
            self.machine = ahocorasick.Automaton()
            for part in parts:
                self.machine.add_word(part, part)
            self.machine.make_automaton()

    def stand_in(self, text: str) -> bool:
        if self.machine is None:
            return any(p in text for p in self.parts)
        return next(self.machine.iter(text), None) is not None


@functools.cache
def _hints() -> tuple[_Parts, _Parts]:
    return _Parts(HINTS), _Parts(SITE_HINTS)


def is_notice(line: str) -> bool:
    """Whether a line has what notices of any wording have. Where its form recurs widely, it is one."""
    system, places, failures, addresses = _NOTICE
    if system.search(line):
        found = failures.search(line) or addresses.search(line)
    else:
        found = places.search(line) and addresses.search(line) and failures.search(line)
    return bool(found) and not _STORY.search(line)


_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_TYPOGRAPHIC = re.compile(r"“[^”\n]*”|「[^」\n]*」|『[^』\n]*』|«[^»\n]*»|„[^“\n]*“")

# Parts of words, at least one of which stands in whatever the phrase rules match.
HINTS = tuple(
    "error|not found|bad gateway|unavailable|forbidden|unauthori|gateway time|denied|permission|status|http|code|fault|"
    "expired|sign in|too many|timed out|in time|could not|couldnot|can not|cannot|connection|down for|maintenance|"
    "been moved|exist any|longer exist|to members|available in|went wrong|been told|try again|reload|start page|"
    "happens again|help desk|human|few seconds|be back|traceback|file \"|exception|stream|quota|requested|introuvable|"
    "existe plus|erreur|nicht gefunden|die adresse|verweigert|encontró|denegado|页面|访问|打开|找到|连接|服务器|请稍后|错误代码|"
    "权限|删除|移除|ページ|見つかりません|アクセス|しばらく|サーバー|script|脚本|スクリプト|ipsum|sit amet|placeholder|for layout|"
    "sample|replace this|text here|chapter here|goes here|starts here|click to edit|asdf|faux texte|text text|blindtext|"
    "platzhalter|relleno|ejemplo|muestra|占位|示例|正式内容|上线前|ダミー|仮の|サンプル|xxx|switch it|switch them|switch this|turn it|turn them|turn this|cannot be|notified|informed|alerted|looking into|working on|help desk|helpdesk|support|webmaster|administrator|robot|verify|prove|eiusmod|ad minim|aute irure|excepteur|adipisci|dummy|filler|body text|body copy|body paragraph".split("|")
)


def judge_line(line: str, hinted: bool = True, phrased: bool = True) -> tuple[int, int, int, int]:
    """Characters of residue, of filler among it, and of real text in a line, and its real sentences.

    Very short sentences of neither kind count as neither. hinted: whether a phrase may stand in the document; phrased:
    whether it may in this line.
    """
    words = line.lower().split()
    if len(words) >= FILLER_WORDS and FUNCTION_WORDS.isdisjoint(words) and _is_babble(line):
        return len(line), len(line), 0, 0
    if not hinted:
        return 0, 0, len(line), 2
    residue = filler = real = sentences = 0
    for sentence in (s.strip() for s in _SENTENCE.findall(line)):
        if not sentence:
            continue
        kind = kind_of(_TYPOGRAPHIC.sub("“”", sentence)) if phrased else None
        if kind:
            residue += len(sentence)
            filler += len(sentence) if kind == "filler" else 0
        elif len(_WORDS.findall(_CJK.sub(" x ", sentence))) > 4:
            real += len(sentence)
            sentences += 1
    return residue, filler, real, sentences


def _can_be_furniture(line: str) -> bool:
    return len(line) <= FURNITURE_CHARS and line[-1] not in ".!?。！？:：,，"


def find_residue(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Documents with signs of residue: ``key``, ``placeholder``, ``residue_chars``, ``filler_chars``, ``real_chars``,
    ``real_sentences`` and ``excluded``.

    key: a unique number. A document is excluded when a placeholder stands in it unquoted, or when at least WHOLE of its
    body is messages, demands or filler, or all of it but one sentence is filler. Documents without any sign, null and
    empty ones among them, give no row. Repeated documents are judged alike. A null source is a source. The forms'
    recurrence is counted over all documents; in a table of few documents no line is furniture and only phrases tell a
    message. Other columns are not read; empty tables give no row.
    """
    chosen = documents.select(F.col(key).cast("bigint"), F.col(source).cast("string"), F.col(text)).where(
        F.col(text).isNotNull()
    )
    names = ["h", "source", "n", "edges", "key", "placeholder", "notice", "residue", "filler", "real", "sentences"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int32()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, sites = _hints()
        for batch in batches:
            seen: dict[tuple[int, str], list[int]] = {}
            rows = []
            for k, origin, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = body.lower()
                hinted = phrases.stand_in(low) or bool(_X_HINT.search(low))
                placeholder = has_placeholder(body)
                lines = [x for x in map(str.strip, body.splitlines()) if x]
                judged = [
                    judge_line(x, hinted, hinted and (phrases.stand_in(x.lower()) or bool(_X_HINT.search(x.lower() + " ")))) for x in lines
                ]
                site = sites.stand_in(low)
                notices = [site and sites.stand_in(x.lower()) and is_notice(x) for x in lines]
                grouped: dict[int, int] = {}
                forms: list[int | None] = []
                for i, x in enumerate(lines):
                    edge = _can_be_furniture(x) and not EDGE_LINES <= i < len(lines) - EDGE_LINES
                    forms.append(_hash(x) if edge or notices[i] else None)
                    if forms[-1] is not None:
                        grouped[forms[-1]] = max(grouped.get(forms[-1], 0), int(edge))
                for h, edge in grouped.items():
                    held = seen.setdefault((h, origin or ""), [0, 0])
                    held[0] += 1
                    held[1] += edge
                if placeholder or any(j[0] for j in judged) or any(notices):
                    # Lines that no group can change come as one row.
                    plain = [j for h, j in zip(forms, judged, strict=True) if h is None]
                    rows.append((None, None, None, None, k, placeholder, False, *(sum(j[i] for j in plain) for i in range(4))))
                    rows += [
                        (h, None, None, None, k, placeholder, notice, *j)
                        for h, notice, j in zip(forms, notices, judged, strict=True)
                        if h is not None
                    ]
            rows += [(h, origin, n, edges, *[None] * 7) for (h, origin), (n, edges) in seen.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    fields = (
        "h bigint, source string, n bigint, edges bigint, key bigint, placeholder boolean, notice boolean, "
        "residue int, filler int, real int, sentences int"
    )
    found = stage(chosen.mapInArrow(run, fields), "lines")
    groups = (
        found.where("key IS NULL")
        .groupBy("h", "source")
        .agg(F.sum("n").alias("n"), F.sum("edges").alias("edges"))
        .groupBy("h")
        .agg(F.sum("n").alias("n"), F.sum("edges").alias("edges"), F.count("*").alias("sources"))
        .select(
            "h",
            ((F.col("edges") >= FURNITURE_DOCUMENTS) & (F.col("sources") >= FURNITURE_SOURCES)).alias("furniture"),
            ((F.col("n") >= NOTICE_DOCUMENTS) & (F.col("sources") >= NOTICE_SOURCES)).alias("wide"),
        )
        .where("furniture OR wide")
    )
    told = F.col("wide") & F.col("notice")
    quiet = F.col("furniture") & (F.col("residue") == 0)
    chars = F.col("residue") + F.col("real")
    classed = (
        found.where("key IS NOT NULL AND h IS NOT NULL")
        .join(groups, "h", "left")
        .na.fill(False, ["furniture", "wide"])
        .select(
            "key", "placeholder",
            F.when(told, chars).otherwise(F.col("residue")).alias("residue"),
            "filler",
            F.when(told | quiet, 0).otherwise(F.col("real")).alias("real"),
            F.when(told | quiet, 0).otherwise(F.col("sentences")).alias("sentences"),
        )
    )
    rest = found.where("key IS NOT NULL AND h IS NULL").select("key", "placeholder", "residue", "filler", "real", "sentences")
    sums = classed.unionByName(rest).groupBy("key").agg(
        F.max("placeholder").alias("placeholder"),
        *[
            F.sum(c).alias(name)
            for c, name in (
                ("residue", "residue_chars"), ("filler", "filler_chars"), ("real", "real_chars"), ("sentences", "real_sentences"),
            )
        ],
    ).where("placeholder OR residue_chars > 0")
    whole = F.col("residue_chars") >= WHOLE * (F.col("residue_chars") + F.col("real_chars"))
    headed = (F.col("filler_chars") > 0) & (F.col("real_sentences") <= 1)
    excluded = F.col("placeholder") | ((F.col("residue_chars") > 0) & (whole | headed))
    return sums.withColumn("excluded", excluded).withColumnRenamed("key", key)


def _residue(spark: SparkSession, data_dir: str) -> DataFrame:
    return find_residue(read_table(spark, data_dir, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Documents with residue in place of content."""
    return _residue(spark, data_dir).where("excluded").select("doc_id")


def p9_kept(spark: SparkSession, data_dir: str) -> DataFrame:
    """Documents that stay in the corpus, with their sources."""
    documents = read_table(spark, data_dir, "documents").select("doc_id", "source")
    return documents.join(p9_found(spark, data_dir), "doc_id", "left_anti")


QUERIES = {"p9_found": p9_found, "p9_kept": p9_kept}

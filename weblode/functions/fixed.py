"""Word lists, look-up tables and patterns that decide results.

Everything here is data. It is kept in one place, in natural order, so that a
reader can check each list against the published behaviour it must equal.
"""

# ---- fixed values: media extensions and MIME types -------------------------
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "gif", "svg"]
VIDEO_EXTENSIONS = [
    "mp4", "webm", "mov", "m4v", "ogg", "avi", "mkv", "flv", "wmv", "3gp", "3g2",
    "ts", "f4v", "mpg", "mpeg", "asf", "m3u8", "mpd",
]
MEDIA_EXTENSIONS = IMAGE_EXTENSIONS + VIDEO_EXTENSIONS

MIME_TO_EXTENSION = {
    "video/mp4": "mp4",
    "video/webm": "webm",
    "video/ogg": "ogg",
    "video/quicktime": "mov",
    "video/x-m4v": "m4v",
    "video/x-msvideo": "avi",
    "video/x-matroska": "mkv",
    "video/x-flv": "flv",
    "video/x-ms-wmv": "wmv",
    "video/3gpp": "3gp",
    "video/3gpp2": "3g2",
    "video/mp2t": "ts",
    "video/x-f4v": "f4v",
    "video/mpeg": "mpg",
    "video/x-ms-asf": "asf",
    "application/x-mpegurl": "m3u8",
    "application/vnd.apple.mpegurl": "m3u8",
    "application/dash+xml": "mpd",
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/webp": "webp",
    "image/gif": "gif",
    "image/svg+xml": "svg",
}
ALLOWED_CONTENT_TYPES = [
    "image/", "video/", "application/octet-stream", "application/x-mpegurl",
    "application/vnd.apple.mpegurl", "application/dash+xml",
]

# ---- fixed values: attributes read for media --------------------------------
SRC_ATTRS = ["src", "data-src", "data-lazy-src", "data-original", "data-bg"]
SRCSET_ATTRS = ["srcset", "data-srcset", "data-lazy-srcset"]
VIDEO_DATA_ATTRS = [
    "data-video-src", "data-video-url", "data-video", "data-file-url", "data-mp4",
    "data-src-mp4", "data-webm", "data-src-webm", "data-hls", "data-stream-url",
]
EMBED_DATA_ATTRS = VIDEO_DATA_ATTRS + [
    "data-video-id", "data-youtube-id", "data-youtube-url", "data-embed-url",
    "data-vimeo-url", "data-player-url", "data-vturb-url",
]
META_VIDEO_PROPS = [
    "og:video", "og:video:url", "og:video:secure_url", "twitter:player:stream", "twitter:player",
]
OG_EMBED_PROPS = ["og:video", "og:video:url", "og:video:secure_url", "og:image"]
TWITTER_EMBED_PROPS = ["twitter:player", "twitter:player:stream"]

# ---- fixed values: patterns over scripts and styles --------------------------
# the characters that the HTML standard gives numeric references 128 to 159
C1_CHARACTERS = "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"
JS_SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_URL_VIDEO_EXTS = "mp4|webm|mov|m4v|ogg|avi|mkv|flv|wmv|3gp|ts|f4v|mpg|mpeg|m3u8|mpd"
_URL_CHAR = "[^" + JS_SPACE + r"\"'<>\])]"
VIDEO_URL = rf"(?i)https?://{_URL_CHAR}+?\.({_URL_VIDEO_EXTS})(?:[?#]{_URL_CHAR}*)?"
VIDEO_SUFFIX = rf"(?i)\.({_URL_VIDEO_EXTS})(\?|#|$)"
CSS_BACKGROUND = rf"(?i)background(?:-image)?[{JS_SPACE}]*:[^;]*url\([{JS_SPACE}]*[\"']?([^\"')]+?)[\"']?[{JS_SPACE}]*\)"
SCRIPT_FILE = rf"(?i)file[{JS_SPACE}]*:[{JS_SPACE}]*[\"']([^\"']+?\.(mp4|webm|m3u8)[^\"']*?)[\"']"
SCRIPT_SOURCE = rf"(?i)source[{JS_SPACE}]*:[{JS_SPACE}]*[\"']([^\"']+?\.(mp4|webm|m3u8)[^\"']*?)[\"']"
SCRIPT_SRC = rf"(?i)src[{JS_SPACE}]*:[{JS_SPACE}]*[\"']([^\"']+?\.(mp4|webm|mov|ogg|m3u8)[^\"']*?)[\"']"
SCRIPT_JSON_KEY = (
    rf"(?i)[\"']((?:video_?)?(?:url|src|file|stream|source|hls|dash))[\"'][{JS_SPACE}]*:[{JS_SPACE}]*"
    r"[\"'](https?://[^\"']+?\.(mp4|webm|m3u8|mpd|mov|flv)[^\"']*?)[\"']"
)
_PLAIN = "[^" + JS_SPACE + r"\"'<>]+"
PLATFORM_URL = (
    r"(?i)https?://(?:www\.)?(?:youtube(?:-nocookie)?\.com/"
    rf"(?:watch\?{_PLAIN}|embed/{_PLAIN}|shorts/{_PLAIN}|live/{_PLAIN}|clip/{_PLAIN}|playlist\?{_PLAIN}"
    rf"|@[\w.-]+|channel/{_PLAIN})|youtu\.be/{_PLAIN}|vimeo\.com/{_PLAIN}|player\.vimeo\.com/video/{_PLAIN}"
    rf"|holodex\.net/(?:watch|channel|multiview)/{_PLAIN}|(?:scripts|cdn|player)\.converteai\.net/{_PLAIN})"
)
STRUCTURED_SCRIPT_HINT = (
    "(?i)(youtube_url|vimeo_url|video_url|embed_url|converteai|vturb|smartplayer|__NEXT_DATA__|__NUXT__|elementor)"
)
SCRIPT_URL_TAIL = r"[;,'\")\]}>]+$"

# ---- fixed values: player scripts --------------------------------------------
PLAYER_SCRIPT_SRC = (
    r"(?i)^https?://(?:scripts|cdn|na-cdn|cdn-bb|cdn-k|cdn-cf-bb|player|images)\."
    r"(?:converteai\.net|vturb\.com(?:\.br)?)/"
)
PLAYER_PATH = r"(?i)/([a-f0-9-]+)/players/([a-f0-9-]+)/"
PLAYER_AB_PATH = r"(?i)/([a-f0-9-]+)/ab-test/([a-f0-9-]+)/"
PLAYER_INLINE_HINT = "(?i)smartplayer|converteai|vturb|smartvideo"
PLAYER_INLINE_SRC = (
    r"(?i)[\"'](https?://(?:scripts|cdn|player)\.(?:converteai\.net|vturb\.com(?:\.br)?)/"
    r"[^\"']+?player\.js[^\"']*)[\"']"
)
PLAYER_CDN = rf"cdn[{JS_SPACE}]*:[{JS_SPACE}]*[\"']([^\"']+)[\"']"
PLAYER_OID = rf"oid[{JS_SPACE}]*:[{JS_SPACE}]*[\"']([a-f0-9-]+)[\"']"
PLAYER_VIDEO = rf"video[{JS_SPACE}]*:[{JS_SPACE}]*\{{[^}}]*?id[{JS_SPACE}]*:[{JS_SPACE}]*[\"']([a-f0-9]+)[\"']"
PLAYER_COVER = (
    rf"video[{JS_SPACE}]*:[{JS_SPACE}]*\{{[^}}]*?(?:cover|poster)[{JS_SPACE}]*:[{JS_SPACE}]*"
    r"[\"'](https?://[^\"']+)[\"']"
)
PLAYER_LEGACY = [
    rf"(?i)[\"']?(?:mediaUrl|media_url|sourceUrl|source_url|videoUrl|video_url|hls_url|hlsUrl)[\"']?"
    rf"[{JS_SPACE}]*[:=][{JS_SPACE}]*[\"'](https?://[^\"']+?)[\"']",
    r"(?i)[\"'](https?://(?:cdn|na-cdn|cdn-bb|cdn-k|cdn-cf-bb|media|stream)[^\"']*?\.(?:converteai|vturb)"
    r"[^\"']*?\.(?:net|com|com\.br)/[^\"']+?\.(?:m3u8|mp4|webm)(?:\?[^\"']*)?)[\"']",
]
PLAYER_LEGACY_STATIC = r"(?i)\.(js|css|png|jpg|jpeg|gif|svg|ico|woff2?|ttf|eot|map)(\?|#|$)"
PLAYER_LEGACY_VIDEO = r"(?i)\.(m3u8|mp4|webm|mov|mpd)(\?|#|$)"
PLAYER_CONTENT_TYPES = "javascript|text/html|application/json|text/plain"

# ---- fixed values: video platforms --------------------------------------------
PLATFORM_DOMAINS = {
    "youtube": ["youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "youtube-nocookie.com"],
    "vimeo": ["vimeo.com", "player.vimeo.com"],
    "dailymotion": ["dailymotion.com", "dai.ly"],
    "twitch": ["twitch.tv", "clips.twitch.tv"],
    "twitter": ["twitter.com", "x.com"],
    "tiktok": ["tiktok.com"],
    "instagram": ["instagram.com"],
    "holodex": ["holodex.net"],
    "bilibili": ["bilibili.com", "b23.tv"],
    "niconico": ["nicovideo.jp"],
    "vturb": [
        "scripts.converteai.net", "cdn.converteai.net", "na-cdn.converteai.net", "cdn-bb.converteai.net",
        "cdn-k.converteai.net", "cdn-cf-bb.converteai.net", "player.converteai.net", "images.converteai.net",
        "vturb.com", "vturb.com.br", "api.vturb.com.br", "cdn.vturb.com.br",
    ],
}
VTURB_SCRIPT_HOSTS = ["scripts.converteai.net", "player.converteai.net"]
VTURB_CDN_HOSTS = [
    "cdn.converteai.net", "na-cdn.converteai.net", "cdn-bb.converteai.net", "cdn-k.converteai.net",
    "cdn-cf-bb.converteai.net", "cdn.vturb.com.br",
]

# ---- fixed values: links --------------------------------------------------------
HUB_WORDS = [
    "video", "videos", "vídeo", "vídeos", "watch", "assistir", "play", "reproduzir", "media", "mídia",
    "conteudo", "conteúdo", "aula", "aulas", "curso", "modulo", "módulo", "portal", "biblioteca", "playlist",
    "clip", "clips", "live", "lives", "stream", "livestream", "webinar", "aovivo", "ao vivo", "arquivo",
    "acervo", "members", "member", "holodex", "youtube", "vturb", "vsl", "estudo de caso", "depoimento",
    "配信", "切り抜き", "アーカイブ", "歌ってみた",
]
CTA_WORDS = [
    "acessar", "entrar", "ver agora", "abrir", "continuar", "começar", "comecar", "assistir agora", "saiba mais",
]
LEGAL_WORDS = [
    "terms", "privacy", "cookie", "legal", "termos", "privacidade", "política", "imprint", "disclaimer",
    "conditions", "gdpr", "lgpd",
]
SHARE_WORDS = ["share", "social", "sharing"]
AD_WORDS = ["ad-container", "ads-", "advert", "sponsor", "banner-ad"]
SHARE_DOMAINS = [
    "facebook.com", "twitter.com", "linkedin.com", "pinterest.com", "reddit.com", "tumblr.com", "whatsapp.com",
    "t.me",
]
SHARE_PATHS = r"(?i)facebook\.com/sharer|twitter\.com/intent|linkedin\.com/sharing|pinterest\.com/pin/create"
BUTTON_URL_ATTRS = ["data-href", "data-url", "data-link", "data-link-url", "data-target-url", "formaction"]
ONCLICK_URLS = [
    rf"(?i)(?:window\.)?location(?:\.href)?[{JS_SPACE}]*=[{JS_SPACE}]*[\"']([^\"'#]+)[\"']",
    rf"(?i)location\.assign\([{JS_SPACE}]*[\"']([^\"'#]+)[\"'][{JS_SPACE}]*\)",
    rf"(?i)window\.open\([{JS_SPACE}]*[\"']([^\"'#]+)[\"']",
    rf"(?i)router\.push\([{JS_SPACE}]*[\"']([^\"'#]+)[\"'][{JS_SPACE}]*\)",
    rf"(?i)navigate\([{JS_SPACE}]*[\"']([^\"'#]+)[\"'][{JS_SPACE}]*\)",
]
SETTINGS_LINK_KEY = (
    r"(?i)(?:^|\.)(?:url|href|link|target|target_url|link_url|youtube_url|vimeo_url|external_url|watch_url"
    r"|embed_url|video_url|hosted_url)$"
)
SETTINGS_EMBED_KEY = (
    r"(?i)(?:^|\.)(?:youtube_url|vimeo_url|external_url|watch_url|embed_url|video_url|url|hosted_url)$"
)
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source",
]
STATIC_EXTENSIONS = [
    ".css", ".js", ".mjs", ".cjs", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".ico", ".xml", ".rss", ".atom",
    ".json", ".map", ".svg",
]
AUTH_SEGMENTS = [
    "login", "signin", "sign-in", "signup", "sign-up", "register", "logout", "sign-out", "signout", "auth",
    "oauth", "sso", "forgot-password", "reset-password", "password",
]

# ---- fixed values: host safety ---------------------------------------------------
PRIVATE_HOSTS = [
    "localhost$",
    r"127\.",
    r"10\.",
    r"172\.(1[6-9]|2\d|3[01])\.",
    r"192\.168\.",
    r"169\.254\.",
    r"0\.",
    r"100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.",
    "::$",
    "::1$",
    "fc00:",
    "fd",
    "fe80:",
    r"::ffff:(127\.|10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.|0\.)",
    "::ffff:7f[0-9a-f]{2}:[0-9a-f]{1,4}$",
    "::ffff:a[0-9a-f]{2}:[0-9a-f]{1,4}$",
    "::ffff:ac1[0-9a-f]:[0-9a-f]{1,4}$",
    "::ffff:c0a8:[0-9a-f]{1,4}$",
    "::ffff:a9fe:[0-9a-f]{1,4}$",
    "::ffff:0{0,3}[0-9a-f]{0,2}:[0-9a-f]{1,4}$",
    "::ffff:64[4-7][0-9a-f]:[0-9a-f]{1,4}$",
]
MAX_URL_CHARS = 2048
REDIRECT_STATUS = [301, 302, 303, 307, 308]

# ---- fixed values: display names ---------------------------------------------------
PLATFORM_LABELS = {
    "youtube": "YouTube", "vimeo": "Vimeo", "twitch": "Twitch", "tiktok": "TikTok", "instagram": "Instagram",
    "holodex": "Holodex", "dailymotion": "Dailymotion", "bilibili": "Bilibili", "niconico": "Niconico",
    "twitter": "X/Twitter", "vturb": "VTurb", "direct": "Direto",
}
KIND_LABELS = {
    "video": "Vídeo", "live": "Live", "short": "Short", "clip": "Clip", "playlist": "Playlist",
    "channel": "Canal", "embed": "Embed",
}
PAGE_KIND_LABELS = {
    "landing": "Landing", "hub": "Hub", "listing": "Listagem", "media": "Mídia", "platform": "Plataforma",
    "unknown": "Página",
}
RESULT_REASON_LABELS = {
    "content-hub": "hub de conteúdo", "platform-reference": "referência de plataforma",
    "interactive-destination": "destino interativo", "onclick-navigation": "onclick",
    "player-config": "config de player", "data-settings-link": "data-settings",
}
LOG_REASON_LABELS = {
    "content-hub": "hub de conteúdo", "platform-reference": "referência de plataforma",
    "interactive-destination": "destino interativo", "onclick-navigation": "navegação programática",
    "player-config": "configuração de player", "data-settings-link": "link em data-settings",
}
LOG_SOURCE_LABELS = {
    "anchor": "link", "button": "botão", "data_attr": "atributo", "data_settings": "configuração",
    "onclick": "onclick",
}

# ---- fixed values: HTML element groups ----------------------------------------------
VOID_ELEMENTS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
]
RAW_ELEMENTS = ["script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"]
HEAD_ELEMENTS = ["html", "head", "meta", "link", "base", "title", "style", "script", "noscript", "template"]
SVG_LEAVES = ["path", "circle", "rect", "line", "polyline", "polygon", "ellipse", "use", "stop", "image"]
CLOSES_P = [
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "main", "menu", "nav", "ol", "p",
    "pre", "section", "table", "ul",
]

# ---- fixed values: codes of pages that an analysis refuses -----------------------------
ANALYSE_CODES = ["FETCH_FAILED", "NOT_HTML", "HTML_TOO_LARGE"]

"""Word lists, tables and constants that results depend on, as text and in natural order."""

#: Statuses an authentication result may have; anything else is unknown.
AUTH_STATUSES = ["pass", "fail", "softfail", "neutral", "none", "temperror", "permerror", "policy"]

#: Public suffixes of two labels.
SUFFIXES = """
co.uk org.uk ac.uk gov.uk net.uk sch.uk me.uk ltd.uk
com.au net.au org.au edu.au gov.au id.au
co.nz net.nz org.nz govt.nz ac.nz
co.za org.za net.za gov.za ac.za
co.jp ne.jp or.jp ac.jp go.jp ad.jp
com.br net.br org.br gov.br edu.br
com.cn net.cn org.cn gov.cn edu.cn ac.cn
co.in net.in org.in gen.in firm.in ind.in gov.in
com.mx com.ar com.co com.pe com.ve com.ec com.uy
com.sg com.hk com.tw com.my com.ph com.vn com.bd
com.tr com.pl com.ua com.ru org.ru net.ru
co.kr or.kr ne.kr go.kr
co.il org.il net.il ac.il gov.il
co.th in.th ac.th go.th
co.id or.id ac.id go.id web.id
com.sa com.eg com.ng com.pk com.kw com.qa
co.ke co.tz co.ug
com.es com.pt com.gr com.ro com.hr com.cy
""".split()

#: Webmail where anyone can open an account.
FREE_MAIL = "gmail.com outlook.com hotmail.com yahoo.com aol.com protonmail.com proton.me gmx.com mail.com yandex.com zoho.com icloud.com live.com msn.com".split()

#: Brands and the domains they send from, in order of precedence.
BRANDS = [
    ("paypal", ["paypal.com"]),
    ("microsoft", ["microsoft.com", "microsoftonline.com", "office.com", "office365.com"]),
    ("outlook", ["outlook.com", "microsoft.com"]),
    ("office365", ["office.com", "microsoft.com"]),
    ("apple", ["apple.com", "icloud.com"]),
    ("icloud", ["icloud.com", "apple.com"]),
    ("amazon", ["amazon.com", "amazon.co.uk", "amazon.de"]),
    ("google", ["google.com", "gmail.com"]),
    ("gmail", ["gmail.com", "google.com"]),
    ("netflix", ["netflix.com"]),
    ("facebook", ["facebook.com", "fb.com"]),
    ("instagram", ["instagram.com"]),
    ("whatsapp", ["whatsapp.com"]),
    ("linkedin", ["linkedin.com"]),
    ("dropbox", ["dropbox.com"]),
    ("docusign", ["docusign.com", "docusign.net"]),
    ("adobe", ["adobe.com"]),
    ("zoom", ["zoom.us"]),
    ("slack", ["slack.com"]),
    ("github", ["github.com"]),
    ("dhl", ["dhl.com", "dhl.de"]),
    ("fedex", ["fedex.com"]),
    ("ups", ["ups.com"]),
    ("usps", ["usps.com"]),
    ("hsbc", ["hsbc.com", "hsbc.co.uk"]),
    ("chase", ["chase.com"]),
    ("santander", ["santander.com", "santander.co.uk"]),
    ("barclays", ["barclays.co.uk", "barclays.com"]),
    ("citibank", ["citi.com", "citibank.com"]),
    ("wellsfargo", ["wellsfargo.com"]),
    ("bankofamerica", ["bankofamerica.com"]),
    ("revolut", ["revolut.com"]),
    ("binance", ["binance.com"]),
    ("coinbase", ["coinbase.com"]),
    ("metamask", ["metamask.io"]),
    ("steam", ["steampowered.com", "valvesoftware.com"]),
    ("ebay", ["ebay.com"]),
    ("stripe", ["stripe.com"]),
    ("shopify", ["shopify.com"]),
    ("booking", ["booking.com"]),
    ("airbnb", ["airbnb.com"]),
    ("emirates", ["emirates.com"]),
    ("etisalat", ["etisalat.ae"]),
    ("stc", ["stc.com.sa"]),
]

#: Characters that look like a Latin letter, and that letter.
CONFUSABLE = "аеорсхуіјѕԁһӏνοαρεικτυ013456789"
LOOKS_LIKE = "aeopcxyijsdhlvoapeiktuoleasgtbg"

SHORTENERS = "bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly adf.ly j.mp tr.im tiny.cc lnkd.in db.tt qr.ae cur.lv ity.im q.gs po.st su.pr fire.to bit.do mcaf.ee link.tl go.usa.gov go2.me shorl.com".split()
DISPOSABLE = "tempmail.com 10minutemail.com guerrillamail.com mailinator.com throwaway.email temp-mail.org fakeinbox.com trashmail.com yopmail.com sharklasers.com guerrillamail.info grr.la".split()
RISKY_TLDS = "zip mov top xyz gq tk cf ml ga click link live rest country kim work party review trade date wang su icu cyou sbs buzz monster quest fit casa best autos bond cfd lol makeup skin".split()
PROGRAM_URLS = "exe scr js jar msi vbs hta ps1 bat cmd com pif dll iso img lnk apk dmg jse wsf".split()
ARCHIVE_URLS = "zip rar 7z gz tar cab tgz ace".split()
RISKY_FILES = "exe scr js hta vbs bat cmd pif msi com dll ps1 sh bash jar app dmg".split()
DOUBLE_ENDINGS = "pdf.exe doc.exe xls.exe zip.exe pdf.scr doc.scr xls.scr jpg.exe png.exe gif.exe txt.exe".split()

#: Points of the verdict.
SPF_POINTS = {"fail": 30, "softfail": 18, "permerror": 8, "neutral": 5, "none": 5, "temperror": 2, "unknown": 2}
DKIM_POINTS = {"fail": 25, "permerror": 8, "unverified": 4, "none": 5, "unknown": 2}
DMARC_POINTS = {"fail": 35, "none": 5, "unknown": 2}
MISALIGNED, REPLY_TO_ELSEWHERE, WARNING, ALL_PASS = 30, 8, 12, -10
ANOMALY_POINTS = {"high": 12, "medium": 6, "low": 3}
FINDING_POINTS = {"high": 20, "medium": 8}
PART_WEIGHTS = {"auth": 0.6, "iocs": 0.25, "language": 0.15}
HIGH, SUSPICIOUS = 60, 30

#: Weights of shared indicators.
INDICATOR_WEIGHTS = {
    "hash": 100, "ip": 90, "url": 80, "urlDomain": 70, "from": 65, "replyTo": 60, "domain": 55, "messageIdDomain": 40,
    "displayName": 35, "subject": 30, "filename": 25, "mailer": 20,
}
OTHER_WEIGHT = 10

#: Categories of wording: weight of a strong phrase, and weight of the category in the verdict.
LANGUAGE_WEIGHTS = {
    "urgency": (1.0, 0.5), "authority": (1.2, 0.5), "financial": (1.1, 0.8), "credential": (1.3, 0.8), "bec": (1.4, 1.0),
    "lure": (1.1, 0.6), "advancefee": (1.3, 0.9), "social": (1.0, 0.5), "extortion": (1.5, 1.0),
}

#: Stop words by which a language is told, and the share of all words that they must exceed; ties go to the earlier language.
#: Words with accents never match, because words are runs of ASCII word characters; they are kept as the list has them.
STOP_WORDS = {
    "en": ("the and is to of a in that have it for not on with he as you do at this be are was were been will would could should can may might must shall has had did does doing done".split(), 0.2),
    "es": ("el la de que y a en un ser se no haber por con su para como estar tener".split(), 0.25),
    "fr": ("le de et à un il être avoir ne je son que se qui ce dans en du elle au".split(), 0.25),
    "de": ("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split(), 0.25),
}
FEWEST_WORDS = 10

#: Patterns of wording: category, tier and expression. \b, \d and \w are ASCII; white space is any.
LANGUAGE_PATTERNS = [
    ("financial", "broad", r"[$€£¥₹₽₩₺₦₱]\s?\d[\d,.]*(?:\s?(?:k|m|million|billion))?"),
    ("financial", "broad", r"(?i)\b\d[\d,.]*\s?(?:usd|eur|gbp|aed|sar|inr|cad|aud|chf|jpy|cny|ngn|btc|eth|usdt)\b"),
    ("financial", "strong", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}(?:\s?[A-Z0-9]{1,4})?\b"),
    ("financial", "strong", r"\b(?:bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"),
    ("financial", "strong", r"\b0x[a-fA-F0-9]{40}\b"),
    ("bec", "strong", r"(?i)\b(?:process|approve|release|initiate|arrange|complete|action)\s+(?:a|the|this)?\s*(?:urgent\s+|same[-\s]day\s+)?(?:bank\s+|wire\s+)?(?:transfer|payment|remittance|invoice)\b"),
    ("bec", "strong", r"(?i)\bwire\s+(?:the\s+)?(?:funds|money|amount|total|\$[\d,.]+)\b"),
    ("bec", "strong", r"(?i)\btransfer\s+(?:the\s+)?(?:funds|money|amount|\$[\d,.]+)\b"),
    ("bec", "strong", r"(?i)\b(?:i\s*am|i'm)\s+(?:currently\s+)?(?:in|on)\s+(?:a\s+)?(?:meeting|call|conference)\b"),
    ("bec", "strong", r"(?i)\b(?:cannot|can't|can\s+not|won't|will\s+not|unable\s+to)\s+(?:be\s+reached|be\s+contacted|talk|speak|discuss|call)\b"),
    ("bec", "strong", r"(?i)\b(?:i\s+will\s+be|i'll\s+be|i\s+am)\s+unreachable\b"),
    ("bec", "strong", r"(?i)\b(?:account|routing|swift|iban|sort\s*code|bic)\s*(?:number|code|no\.?)?\s*[:#](?=\s*[A-Z0-9])"),
    ("bec", "strong", r"(?i)\bdo\s+not\s+(?:delay|discuss|tell|mention|share|inform)\b"),
    ("bec", "strong", r"(?i)\bjust\s+handle\s+it\b"),
    ("bec", "strong", r"(?i)\bsend\s+me\s+the\s+(?:confirmation|receipt|proof)\b"),
    ("social", "strong", r"(?i)\b(?:call|contact|dial|phone|reach)\b[^.\n]{0,40}?\+?\d[\d\s().-]{7,}\d"),
]

#: Names of the categories of wording, in order.
LANGUAGE_LABELS = {
    "urgency": "Urgency / Pressure", "authority": "Authority / Fear / Threat", "financial": "Money / Financial", "credential": "Credential Harvesting",
    "bec": "BEC / Payment Fraud", "lure": "Lure / Reward / Seduction", "advancefee": "Advance-Fee / 419 Scam", "social": "Social Engineering",
    "extortion": "Extortion / Sextortion",
}

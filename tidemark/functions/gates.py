"""What must not be captured: private browsing and login screens, told by the first marker found; browsers and identities of apps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, in the order in which they are looked for.
BROWSERS = [
    "chrome", "chromium", "thorium", "brave", "edge", "iexplore", "vivaldi", "opera", "arc", "comet", "dia browser", "sigmaos", "wavebox", "whale", "yandex", "maxthon", "duckduckgo", "ghostery", "safari", "orion", "kagi",
    "epiphany", "falkon", "qutebrowser", "midori", "firefox", "waterfox", "librewolf", "floorp", "mullvad", "palemoon", "pale moon", "seamonkey", "tor browser", "zen",
]
PRIVATE = ["incognito", "inprivate", "in private", "incognito mode", "inprivate browsing", "private browsing", "private window", "private tab", "private mode", "edge://inprivate", "about:privatebrowsing", "about:incognito"]
MANAGER_BUNDLES = "com.1password.1password com.agilebits.onepassword7 com.bitwarden.desktop org.keepassxc.keepassxc com.lastpass.lastpass com.dashlane.dashlanephonefinal in.sinew.enpass-desktop com.apple.passwords com.apple.keychainaccess".split()
MANAGERS = "1password bitwarden keepassxc lastpass dashlane enpass passwords keychain".split()
LOGIN_HOSTS = "login. logon. signin. signon. sso. auth. oauth. openid. accounts. idp. identity. adfs. sts. mfa.".split()
LOGIN_PATHS = (
    "login login2 log-in log_in logon log-on signin sign-in sign_in sign_in_with_password signon sign-on servicelogin wp-login j_security_check authenticate authorize authorization oauth oauth2 openid openid-connect oidc "
    "saml saml2 samlsso sso ssologin adfs sts idp 2fa 2step mfa otp totp u2f webauthn passkey two-factor twofactor password passwords change-password new-password reset-password password-reset resetpassword "
    "forgot-password forgotpassword recover-password credentials"
).split()
PAGE_ENDING = r"\.(?:aspx?|php\d?|phtml|x?html?|jspx?|jsf|cgi|cfm|esp|do|action)$"
LOGIN_PHRASES = ["sign in", "sign on", "log in", "log on", "passkey", "two-factor", "verification code", "enter your password", "authentication required", "single sign-on"]
LOGIN_TITLES = ["login", "logon", "signin", "signon"]
TITLE_SEPARATOR = r"\s*[|•·—–]\s*|\s+-\s+"
BROWSER_BUNDLES = (
    "com.apple.Safari com.google.Chrome com.google.Chrome.canary org.chromium.Chromium com.brave.Browser com.microsoft.edgemac com.operasoftware.Opera com.vivaldi.Vivaldi company.thebrowser.Browser org.mozilla.firefox "
    "org.mozilla.firefoxdeveloperedition com.sigmaos.sigmaos org.webkit.MiniBrowser"
).split()
BROWSER_NAMES = ["Google Chrome", "Chromium", "Brave Browser", "Microsoft Edge", "Opera", "Vivaldi", "Firefox", "Safari", "Arc", "chrome", "msedge", "brave", "opera", "vivaldi", "firefox"]
NO_SITES = ["newtab"]


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))


def _process(name: Column) -> Column:
    return F.regexp_replace(_plain(name), r"\.(exe|app)$", "")


def _first(values: list[str], test) -> Column:
    """The first of the values that passes, else null."""
    return F.get(F.filter(F.array(*map(F.lit, values)), test), 0)


def is_browser(process: Column, bundle: Column) -> Column:
    """Whether an app is a known browser by its bundle or its name."""
    return F.coalesce(bundle.isin(BROWSER_BUNDLES), F.lit(False)) | F.coalesce(process.isin(BROWSER_NAMES), F.lit(False))


def app_identity(app: Column, host: Column) -> Column:
    """The site's host in lower case without `www.`, if it is a real site, else the app."""
    h = F.lower(F.coalesce(host, F.lit("")))
    return F.when((h != "") & ~h.isin(NO_SITES), F.regexp_replace(h, r"^www\.", "")).otherwise(app)


def is_passive(kinds: Column) -> Column:
    """Whether an array of kinds of events has no click, key or scroll."""
    return ~F.exists(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: F.coalesce(k.isin("click", "keyboard", "scroll"), F.lit(False)))


def all_exclusions(*layers: Column) -> Column:
    """The union of layers (arrays of strings), each entry once, in the order of layers; null layers and entries are none."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.flatten(F.array(*(F.coalesce(x, none) for x in layers))), lambda x: x.isNotNull()))


def private_marker(process: Column, bundle: Column, title: Column, url: Column) -> Column:
    """The marker of private browsing in a likely browser's title or address, else null."""
    name, b, t, u = _process(process), _plain(bundle), _plain(title), _plain(url)
    likely = _first(BROWSERS, lambda m: F.contains(name, m) | F.contains(b, m)).isNotNull()
    return F.when(likely, _first(PRIVATE, lambda m: F.contains(t, m) | F.contains(u, m)))


def login_marker(process: Column, bundle: Column, title: Column, url: Column) -> Column:
    """What tells a login screen, else null: a password manager; a host's beginning, a part of the path, or a part of a redirect in the address; a phrase of whole words, or a whole part, of the title."""
    b, name, t, u = _plain(bundle), _process(process), _plain(title), _plain(url)
    manager = F.coalesce(_first(MANAGER_BUNDLES, lambda m: b == m), _first(MANAGERS, lambda m: F.contains(name, m)))
    rest = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*:(//)?", "")
    host, path, query = F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/:?#]*)", 1), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"\?([^#]*)", 1)
    bare = F.regexp_replace(host, r"^www\.", "")
    by_host = F.concat(F.lit("host="), _first(LOGIN_HOSTS, lambda m: F.startswith(host, m) | F.startswith(bare, m)))
    known = lambda x: x.isin(LOGIN_PATHS)
    by_path = F.concat(F.lit("path="), F.get(F.filter(F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, PAGE_ENDING, "")), known), 0))
    values = F.transform(F.split(query, "&"), lambda p: F.coalesce(F.try_url_decode(F.regexp_replace(p, r"^[^=]*=?", "")), F.lit("")))
    words = F.flatten(F.transform(F.filter(values, lambda v: v.rlike(r"^(?:/|https?://)")), lambda v: F.split(v, "[^a-z0-9]+")))
    by_redirect = F.concat(F.lit("redirect="), F.get(F.filter(words, known), 0))
    address = F.when((u != "") & ~host.rlike(r"\s"), F.coalesce(by_host, by_path, by_redirect))
    phrase = _first(LOGIN_PHRASES, lambda m: F.regexp_like(t, F.concat(F.lit("(?<![a-z0-9])"), m, F.lit("(?![a-z0-9])"))))
    part = F.get(F.filter(F.split(t, TITLE_SEPARATOR), lambda s: F.trim(s).isin(LOGIN_TITLES)), 0)
    return F.coalesce(manager, address, F.concat(F.lit("title="), F.coalesce(phrase, F.trim(part))))

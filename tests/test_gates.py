"""Gates of capture: login screens and private browsing, by title, address and app."""

from pyspark.sql import functions as F

from tidemark.functions import gates

LOGIN = [
    (None, None, "Okta", "https://login.okta.com/", "host=login."), (None, None, "Google Accounts", "accounts.google.com", "host=accounts."), (None, None, "Authorize application", "https://example.com/oauth/authorize", "path=oauth"),
    (None, None, "Sign in to GitHub", None, "title=sign in"), (None, None, "Log in | Slack", None, "title=log in"), (None, None, "Login • Acme", None, "title=login"), (None, None, "Use a saved passkey for example.com", None, "title=passkey"),
    (None, None, "Logon", None, "title=logon"), (None, None, "Log on to Acme Portal", None, "title=log on"), (None, None, "Acme Portal", "https://portal.acme.com/logon.aspx", "path=logon"), (None, None, "Acme", "https://acme.com/login.php", "path=login"),
    (None, None, "Logon tips", "https://example.com/blog/logon-tips.html", None),
    (None, None, "Slack", "https://example-team.slack.com/?redir=%2Fssb%2Fsignin_redirect%3Fssb_vid%3Dredacted%26is_ssb_browser_signin%3D1", "redirect=signin"), (None, None, "search results", "https://example.com/search?q=login", None),
    (None, None, "Login-screen capture gate by octocat · Pull Request #271 · example-org/example-repo", None, None), (None, None, "Login for Linear - user@example.com - Example Mail", None, None), (None, None, "Passkeys and security keys", None, None),
    ("KeePassXC.exe", None, "Vault", None, "keepassxc"), ("x", "com.1Password.1password", "Vault", None, "com.1password.1password"), ("Passwords", "com.apple.Passwords", "Passwords", None, "com.apple.passwords"), ("Keychain Access", None, "Login Keychain", None, "keychain"),
    (None, None, "Passwords - Settings", "chrome://settings/passwords", "path=passwords"), (None, None, "Authentication | Supabase", "https://supabase.com/dashboard/project/abc/auth/users", None), (None, None, "Create your account", "https://acme.com/signup", None),
    (None, None, "Sign in - Google Accounts - Comet", None, "title=sign in"), (None, None, "login.tsx — Visual Studio Code", None, None), (None, None, "1Password Pricing", "https://1password.com/pricing", None),
    (None, None, "Menu", "https://expresso.com/menu", None), (None, None, "password requirements", None, None), (None, None, "Sign in to Acme", "https://acme.com/portal", "title=sign in"),
    (None, None, "Acme", "https://keycloak.acme.com/realms/acme/protocol/openid-connect/auth", "path=openid-connect"), (None, None, "Acme", "https://acme.com/users/sign_in", "path=sign_in"), (None, None, "Acme Blog", "https://acme.com/wp-login.php", "path=wp-login"),
    (None, None, "Google", "https://accounts.google.com/ServiceLogin", "host=accounts."), (None, None, "Acme", "https://sts.acme.com/adfs/ls/?wa=wsignin1.0", "host=sts."), (None, None, "Contributors", "https://authors.example.com/profile", None),
    (None, None, "Assign inventory - Warehouse", None, None), (None, None, None, None, None), ("", "", " ", "%zz?a=%", None), (None, None, "Acme", "https://www.login.acme.com", "host=login."),
]
SCHEMA = "process string, bundle string, title string, url string, want string"


def test_login(spark):
    df = spark.createDataFrame(LOGIN, SCHEMA)
    for r in df.withColumn("got", gates.login_marker(*(F.col(c) for c in ("process", "bundle", "title", "url")))).collect():
        assert r.got == r.want, r


def test_private(spark):
    rows = [("Google Chrome", None, "New Incognito tab", None, "incognito"), ("msedge.exe", None, "x - InPrivate", None, "inprivate"), ("x", "org.mozilla.firefox", None, "about:privatebrowsing", "about:privatebrowsing"), ("Notes", None, "private window", None, None), ("Safari", None, "Private Browsing", "", "private browsing"), (None, None, None, None, None)]
    for r in spark.createDataFrame(rows, SCHEMA).withColumn("got", gates.private_marker(*(F.col(c) for c in ("process", "bundle", "title", "url")))).collect():
        assert r.got == r.want, r


def test_identities(spark):
    rows = [("Google Chrome", None, "WWW.Example.com", ["app_change"], ["a", "b"], ["b", None]), ("x", "com.apple.Safari", "newtab", ["scroll"], None, ["c"]), ("x", None, "", None, [], None), (None, None, None, [None, "keyboard"], ["z", "z"], None)]
    df = spark.createDataFrame(rows, "app string, bundle string, host string, kinds array<string>, own array<string>, more array<string>")
    got = df.select(gates.is_browser(F.col("app"), F.col("bundle")), gates.app_identity(F.col("app"), F.col("host")), gates.is_passive(F.col("kinds")), gates.all_exclusions(F.col("own"), F.col("more"))).collect()
    assert [tuple(r) for r in got] == [(True, "example.com", True, ["a", "b"]), (True, "x", False, ["c"]), (False, "x", True, []), (False, None, False, ["z"])]

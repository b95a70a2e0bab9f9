"""Labelled findings written by hand, apart from what the forest learns from: (text, path, secrets in it).

The values are drawn at run time; the lines around them are such as stand in public manuals, lock files and logs.
"""

import random
import string

R = random.Random(20)
ALNUM, HEX, B64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"


def pick(letters, n):
    return "".join(R.choices(letters, k=n))


def one(template, value, path=""):
    return template.replace("@", value), path, [value]


def none(text, path=""):
    return text, path, []


def findings():
    b = "Before it a line of prose.\n"
    yes = [
        one(b + "export STRIPE_SECRET_KEY=@\nnpm start", "sk_live_" + pick(ALNUM, 24), "deploy.sh"), one('curl -H "Authorization: Bearer @" https://api.host.io/v1/me', pick(ALNUM + "_-", 43)),
        one("aws_access_key_id = @\nregion = eu-west-1", "AKIA" + pick(string.ascii_uppercase + "234567", 16), "credentials"), one("aws_secret_access_key = @\n", pick(B64, 40), "credentials"),
        one('{"type": "service", "private_key_id": "@", "client": 1}', pick(HEX, 40), "service.json"), one("SLACK_TOKEN: @", "xoxp-" + pick(string.digits, 12) + "-" + pick(string.digits, 12) + "-" + pick(HEX, 32), "ci.yml"),
        one("//registry.host.org/:_authToken=@", "npm_" + pick(ALNUM, 36), ".npmrc"), one("git clone https://oauth2:@@host.org/a/b.git".replace("@@", "@ "), "glpat-" + pick(ALNUM, 20)),
        one("const apiKey = '@';", "AIza" + pick(ALNUM + "_-", 35), "map.js"), one("SENDGRID_API_KEY=@", "SG." + pick(ALNUM, 22) + "." + pick(ALNUM, 43), ".env"),
        one("Set the token: @ and start again.", "ghp_" + pick(ALNUM, 36), "notes.txt"), one("password: \"@\"\nuser: \"root\"", "tR4!k" + pick(ALNUM, 9) + "#9", "values.yaml"),
        one("jwt = \"@\"", "eyJhbGciOiJI" + pick(ALNUM, 20) + "." + pick(ALNUM, 70) + "." + pick(ALNUM + "-_", 43), "client.py"), one("client_secret=@&grant_type=code", pick(ALNUM + "~_.", 34)),
        one("HF_TOKEN=@", "hf_" + pick(ALNUM, 34), ".env"), one("OPENAI_API_KEY=@", "sk-" + pick(ALNUM, 48), ".env"), one('"accessToken": "@"', pick(HEX, 64), "state.json"), one("db.password=@", pick(ALNUM, 22), "app.properties"),
        one(b + "@\n" + b, "-----BEGIN EC PRIVATE KEY-----\n" + "\n".join(pick(B64, 64) for _ in range(3)) + "\n-----END EC PRIVATE KEY-----", "id.pem"), one("TWILIO_AUTH_TOKEN = '@'", pick(HEX, 32), "settings.py"),
    ]
    no = [
        none(f"git checkout {pick(HEX, 40)}\n"), none(f"commit {pick(HEX, 40)}\nAuthor: someone", "log.txt"), none(f"sha256:{pick(HEX, 64)} layer.tar", "image.lock"), none(f"file.zip  md5 {pick(HEX, 32)}"),
        none(f'"integrity": "sha512-{pick(B64, 86)}=="', "package-lock.json"), none(f"golang.org/x/net v0.1.0 h1:{pick(B64, 43)}=", "go.sum"), none(f"request id {pick(HEX, 8)}-{pick(HEX, 4)}-{pick(HEX, 4)}-{pick(HEX, 4)}-{pick(HEX, 12)} failed"),
        none("Rindfleischetikettierungsueberwachungsaufgabenuebertragungsgesetz heisst es."), none("import org.company.service.internal.ConnectionFactoryBuilder;", "A.java"), none("from /usr/local/share/applications/preferences/default read it"), none("AbstractSingletonProxyFactoryBean is a class of long standing"),
        none("password = os.environ.get('DB_PASSWORD')", "settings.py"), none("api_key: ${API_KEY}", "values.yaml"), none("token = <your-token-goes-here>", "readme.md"), none("The password must have twelve signs at least."), none("secret: changeme-changeme-changeme", "docs/readme.md"),
        none(f"<img src=\"data:image/png;base64,{pick(B64, 900)}=\">", "a.html"), none("=" * 40 + "\n" + "-" * 40 + "\n" + "_" * 25), none("call 00491701234567890123456789 for more"), none("ISBN 978-3-16-148410-0, EAN 4006381333931400638133393140"), none("https://www.host.org/articles/2024/11/the-quick-brown-fox-jumps-over"),
        none("def test_token_is_refreshed_when_it_has_expired(client):", "tests/test_auth.py"), none("max_token_count=tokenizer.model_max_length", "train.py"), none("background-color-secondary-dark-hover-active", "a.css"), none("auth: required, secret: optional, token: string"), none("2024-11-05T101112.123456789+00:00 started"),
        none("const primaryButtonContainerElement = document.getElementById('primary-button-container');", "a.js"), none("key=value; other_key=other_value; third=3"), none("acide désoxyribonucléique anticonstitutionnellement"), none("x" * 300), none("ATGCGTACGTTAGCATCGATCGGCTAGCTAGGATCCGATCGTACG is a sequence"),
    ]
    return yes + no

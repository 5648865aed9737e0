"""The models against strings that the training generator did not make: names of the standard library, digests and keys."""

import base64
import hashlib
import importlib

from agora.llm import secrets

MODULES = "argparse ast asyncio collections concurrent.futures ctypes datetime decimal email.message http.client inspect ipaddress json logging.handlers mailbox multiprocessing os pathlib pickle plistlib selectors shutil signal smtplib socket sqlite3 ssl statistics string subprocess sys tarfile threading tkinter token tokenize typing unittest.mock urllib.request uuid xml.dom.minidom zipfile".split()


def ordinary():
    names = set()
    for m in MODULES:
        try:
            mod = importlib.import_module(m)
        except ImportError:
            continue
        for a in vars(mod):
            names |= {a, *vars(getattr(mod, a))} if isinstance(getattr(mod, a), type) else {a}
    names |= {f"{a}_{b}" for a, b in zip(sorted(names)[::7], sorted(names)[3::11], strict=False)}
    return sorted(n for n in names if len(n) >= 20 and secrets.TOKEN.fullmatch(n.encode()))


def random_ones():
    out = []
    for k in range(400):
        d = hashlib.sha512(f"key {k}".encode()).digest()
        size = 12 + k % 30
        out += [base64.b64encode(d[: 15 + k % 20]).decode().rstrip("="), base64.urlsafe_b64encode(d[:size + 3]).decode().rstrip("="), base64.b32encode(d[:size + 1]).decode().rstrip("="), d[:size].hex().upper()]
        out.append("".join(chr(97 + b % 26) if b % 2 else chr(65 + b % 26) for b in d[: 24 + k % 20]))  # letters alone
    return [t for t in out if len(t) >= 20]


def test_precision_and_recall_on_strings_of_other_making():
    model = secrets.train(secrets.labelled_samples())
    found = lambda t: bool([s for s in secrets.find(b"x " + t.encode() + b" y", model) if s[1] == "random"])
    good, bad = ordinary(), random_ones()
    assert len(good) > 300 and len(bad) > 1500
    false, true = sum(map(found, good)), sum(map(found, bad))
    assert true / len(bad) >= 0.97 and false / len(good) <= 0.02, (true / len(bad), false / len(good))


def test_tokens_beside_and_across_base_spans():
    model = secrets.train(secrets.labelled_samples())
    key = "Zq8xKp3VbT7mWc2LrY6nHd9s"
    text = f"password={key} {key} token: {key}/{key} {key}"
    kinds = [k for _, k, _ in secrets.find(text.encode(), model)]
    assert kinds == ["assign", "random", "assign", "random"]

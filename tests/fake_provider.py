"""A provider for tests: the address says what happens."""

import json
import os

from tessera.sources import providers as M


def download(url):
    if "private" in url:
        raise RuntimeError("this video is private\nmore")
    if "login" in url:
        raise PermissionError("Sign in to confirm you are not a bot")
    if "flaky" in url:
        mark = f"{os.environ.get('FAKE_DIR', '/tmp')}/{url.rsplit('/', 1)[-1]}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise TimeoutError("Read timed out")
    if "down" in url:
        raise ConnectionError("connection reset")
    if "empty" in url:
        return None
    n = int(url.rsplit("=", 1)[-1]) if "=" in url else 1
    return {"title": f"title {n}", "items": [(10.0 * i, 10.0 * i + 9, f"item {i} of {n}") for i in range(n)]}


def recogniser(path):
    if path.endswith("bad.wav"):
        raise M.ServiceError(400, "no audio")
    if path.endswith("text.wav"):
        return json.dumps({"text": "all of it"})
    return json.dumps({"segments": [{"start": 0, "end": 2.5, "text": f"from {path}"}, {"start": 3, "end": 4, "text": ""}]})


def memory(question):
    if "down" in question:
        raise ConnectionError("connection refused")
    return json.dumps({"results": [{"content": f"about {question}"}, {"content": "more"}]})


def model(prompt):
    """A model that tells what it reads: fails on a word, cites what is there and what is not."""
    import re

    ids = re.findall(r"^\[(\S+) ", prompt, re.M)
    if "explode" in prompt:
        raise RuntimeError("model failed")
    if "silence" in prompt:
        return "I have nothing to say."
    if "Join these" in prompt:
        return "```json\n" + json.dumps({"quick_overview": "" if "no whole" in prompt else f"whole of {prompt.count(chr(10)) - 1}"}) + "\n```"
    if "Summarise" in prompt:
        return "Sure: " + json.dumps({"chunk_overview": f"about {ids[0]}", "local_claims": [{"claim": "cited", "segment_ids": [ids[0], "seg_9999"]}, {"claim": "not cited", "segment_ids": ["seg_9999"]}, {"claim": " "}]})
    nodes = [{"title": "t", "claim": "first", "evidence_segment_ids": [ids[0], "seg_9999", ids[0]], "confidence": 0.9, "status": "supported"}, {"claim": "unsure", "evidence_refs": [{"segment_id": ids[-1]}], "confidence": 7, "status": "odd", "time_start": 3}]
    nodes += [{"summary": "nothing behind it", "status": "supported"}, {"claim": "weak", "evidence_segment_ids": ids, "confidence": 0.2, "status": "supported"}]
    return json.dumps({"nodes": nodes})

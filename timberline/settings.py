"""Settings of the sixteen public log collections."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """``masks``: patterns of variables; ``spaced``: literals after which a space is put."""

    log_format: str
    masks: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    spaced: tuple[str, ...] = ()
    digits_vary: bool = False
    brain_threshold: int = 4
    drain_similarity: float = 0.5
    drain_depth: int = 4
    spell_tau: float = 0.5
    bigram_threshold: int = 15
    trigram_threshold: int = 10
    anchor_threshold: float = 0.4


_IP = r"(\d+\.){3}\d+"
_NAME = r"([\w-]+\.){2,}[\w-]+"

# Log formats, masks and thresholds of each collection.
SETTINGS = {
    "HDFS": Settings("<Date> <Time> <Pid> <Level> <Component>: <Content>", (r"blk_-?\d+", _IP + r"(:\d+)?"), (), (":",), False, 2, 0.5, 4, 0.7, 15, 10, 0.4),
    "Hadoop": Settings(r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>", (_IP,), (), ("_", ":", "=", "(", ")"), True, 6, 0.5, 4, 0.7, 9, 10, 0.45),
    "Spark": Settings("<Date> <Time> <Level> <Component>: <Content>", (_IP, r"\b[KGTM]?B\b", _NAME), (), (":",), False, 4, 0.5, 4, 0.55, 15, 10, 0.86),
    "Zookeeper": Settings(r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>", (r"(/|)(\d+\.){3}\d+(:\d+)?",), (), (":", "="), True, 3, 0.5, 4, 0.7, 15, 10, 0.3),
    "BGL": Settings("<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>", (r"core\.\d+",), (), ("=", "..", "(", ")"), False, 6, 0.5, 4, 0.75, 92, 4, 0.66),
    "HPC": Settings("<LogId> <Node> <Component> <State> <Time> <Flag> <Content>", (), (), ("=", "-", ":"), False, 5, 0.5, 4, 0.65, 15, 10, 0.4),
    "Thunderbird": Settings(r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>", (_IP,), (), (":", "="), False, 3, 0.5, 4, 0.5, 35, 32, 0.74),
    "Windows": Settings("<Date> <Time>, <Level>                  <Component>    <Content>", (r"0x.*?\s",), (), (":", "=", "[", "]"), False, 3, 0.7, 5, 0.7, 15, 10, 0.3),
    "Linux": Settings(r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>", (_IP, r"\d{2}:\d{2}:\d{2}", r"J([a-z]{2})"), (), ("=", ":"), False, 4, 0.39, 6, 0.55, 120, 100, 0.3),
    "Android": Settings("<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>", (r"(/[\w-]+)+", _NAME, r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b"), (), ("(", ")", ":", "="), False, 5, 0.2, 6, 0.95, 15, 10, 0.07),
    "HealthApp": Settings(r"<Time>\|<Component>\|<Pid>\|<Content>", (), (), (":", "=", "|"), False, 4, 0.2, 4, 0.5, 15, 10, 0.25),
    "Apache": Settings(r"\[<Time>\] \[<Level>\] <Content>", (_IP,), (), (), False, 4, 0.5, 4, 0.6, 15, 10, 0.4),
    "OpenSSH": Settings(r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>", (_IP, _NAME), (), (), False, 6, 0.6, 5, 0.8, 88, 81, 0.4),
    "OpenStack": Settings(r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>", (r"((\d+\.){3}\d+,?)+", r"/.+?\s ", r"\d+"), (), (), False, 6, 0.5, 5, 0.9, 30, 25, 0.01),
    "Mac": Settings(r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>", (_NAME,), (), (), False, 5, 0.7, 6, 0.6, 2, 2, 0.01),
    "Proxifier": Settings(r"\[<Time>\] <Program> - <Content>", (r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"), (r"\(.*?\)",), (), False, 3, 0.6, 3, 0.85, 500, 470, 0.4),
}

# Masks of four collections as older scripts have them, in order.
LEGACY_MASKS = {
    "Apache": (
        r"\[[A-Z][a-z]{2}\s+[A-Z][a-z]{2}\s+\d{2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\]",
        r"\[(notice|error|warn|debug|info|crit|alert|emerg)\]",
        r"\[client\s+\d{1,3}(?:\.\d{1,3}){3}\]",
        r"\d{1,3}(?:\.\d{1,3}){3}",
        r"(?<=child )\d+",
        r"(?<=slot )\d+",
        r"(?<=state )\d+",
        r"(?<=init )\d+\s+-?\d+",
        r"/[A-Za-z0-9_./-]+",
        r"workers2\.properties",
        r"Directory index forbidden by rule",
        r"jk2_init\(\) Found child",
        r"jk2_init\(\) Can't find child",
        r"workerEnv\.init\(\) ok",
        r"mod_jk child workerEnv in error state",
        r"mod_jk child init",
        r"mod_proxy child init",
        r"mod_rewrite child init",
        r"mod_headers child init",
    ),
    "OpenSSH": (
        r"(\d+\.){3}\d+",
        r"([\w-]+\.){2,}[\w-]+",
        r"\d{2}:\d{2}:\d{2}",
        r"(?<=sshd\[)\d+(?=\])",
        r"(?<=port )\d+",
        r"(?<=password for invalid user )\S+(?= from)",
        r"(?<=password for )\S+(?= from)",
        r"(?<=[Ii]nvalid user )\S+(?= from)",
        r"(?<=[Ii]nvalid user )\S+(?= \[)",
        r"(?<=for user )\S+",
        r"(?<=failures for )\S+(?= \[)",
        r"(?<=user=)\S+",
    ),
    "OpenStack": (r"((\d+\.){3}\d+,?)+", r"/.+?\s ", r"\d+"),
    "Zookeeper": (
        r"(/|)(\d+\.){3}\d+(:\d+)?",
        r"\d{4}-\d{2}-\d{2}",
        r"\d{2}:\d{2}:\d{2},\d{3}",
        r"(?<=@)[0-9a-fA-F]+",
        r"0x[0-9a-fA-F]+",
        r"(?<=Thread-)\d+",
        r"(?<=myid=)\d+",
        r"(?<=sid:)\d+",
        r"(?<=cport:)-?\d+",
        r"(?<=snapshot\.b)[0-9a-fA-F]+",
    ),
}

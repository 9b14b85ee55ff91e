"""Domain vocabularies as data."""

from __future__ import annotations

# Class order of the two tracks.
IOT_CLASSES = ("Benign", "DDoS", "DoS", "Mirai", "Recon", "Spoofing", "WebBased", "BruteForce")
OFFICE_CLASSES = ("Benign", "BruteForce", "DoS", "DDoS", "WebBased", "Bot", "Infiltration")

# Subtypes of each IoT class.
IOT_SUBTYPES = {
    "Benign": ("Benign_Final", "BenignTraffic"),
    "BruteForce": ("DictionaryBruteForce",),
    "DDoS": (
        "DDoS-ACK_Fragmentation", "DDoS-HTTP_Flood", "DDoS-ICMP_Flood", "DDoS-ICMP_Fragmentation", "DDoS-PSHACK_Flood", "DDoS-RSTFINFlood",
        "DDoS-SYN_Flood", "DDoS-SlowLoris", "DDoS-SynonymousIP_Flood", "DDoS-TCP_Flood", "DDoS-UDP_Flood", "DDoS-UDP_Fragmentation",
    ),
    "DoS": ("DoS-HTTP_Flood", "DoS-SYN_Flood", "DoS-TCP_Flood", "DoS-UDP_Flood"),
    "Mirai": ("Mirai-greeth_flood", "Mirai-greip_flood", "Mirai-udpplain"),
    "Recon": ("Recon-HostDiscovery", "Recon-OSScan", "Recon-PingSweep", "Recon-PortScan", "VulnerabilityScan"),
    "Spoofing": ("DNS_Spoofing", "MITM-ArpSpoofing"),
    "WebBased": ("Backdoor_Malware", "BrowserHijacking", "CommandInjection", "SqlInjection", "Uploading_Attack", "XSS"),
}
# Further names of web attacks, compacted.
WEB_NAMES = ("sqlinjection", "xss", "mqttpublish", "commandinjection", "uploadingattack", "backdoormalware", "browserhijacking")

# Compacted office labels.
OFFICE_LABELS = {
    "Benign": ("benign", "benigntraffic"),
    "Bot": ("bot", "botnetares"),
    "BruteForce": ("ftpbruteforce", "sshbruteforce", "sshbruteforcing"),
    "DDoS": ("ddosattackloicudp", "ddoshoic", "ddosloicudp"),
    "DoS": ("dosattackshulk", "dosattacksslowhttptest", "doshulk", "dosslowhttptest"),
    "Infiltration": ("infiltration",),
    "WebBased": ("webattacksql", "webattackxss"),
}
# Marks of attempts without success.
ATTEMPT_MARKS = ("attempted", "startup", "teardown", "closed-port", "closed port")

# Port sets.
HTTP_PORTS = (80, 443, 8080, 8443)
VULNERABLE_PORTS = (21, 22, 23, 25, 53, 80, 110, 135, 139, 143, 443, 445, 1433, 1521, 3306, 3389, 5900, 8080, 8443)

# Payload patterns by family.
PAYLOAD_PATTERNS = {
    "sql": {
        "sql_quote_or": r"('|%27)\s*(or|and)\s+",
        "union_select": r"union\s+(all\s+)?select|union\+select",
        "sql_comment": r"(--|%2d%2d|#|%23)",
        "sql_keyword": r"information_schema|sleep\s*\(|benchmark\s*\(|select\s+",
    },
    "xss": {
        "script_tag": r"<\s*script|%3cscript",
        "event_handler": r"onerror\s*=|onload\s*=|onclick\s*=",
        "javascript_uri": r"javascript\s*:|javascript%3a",
        "alert_call": r"alert\s*\(|alert%28",
    },
    "login": {
        "http_post": r"\bpost\s+/.+http/",
        "login_endpoint": r"login|signin|wp-login|user\\.php",
        "credential_field": r"(username|user|email|login|password|pass|pwd)=",
        "form_encoded": r"content-type:\s*application/x-www-form-urlencoded",
    },
}

# Addresses of the distributed attackers and of the bot's victims.
DDOS_ATTACKERS = (
    "18.218.115.60", "18.219.9.1", "18.219.32.43", "18.218.55.126", "52.14.136.135", "18.219.5.43", "18.216.200.189", "18.218.229.235", "18.218.11.51", "18.216.24.42",
)
BOT_VICTIMS = (
    "172.31.69.6", "172.31.69.8", "172.31.69.10", "172.31.69.12", "172.31.69.14", "172.31.69.17", "172.31.69.23", "172.31.69.26", "172.31.69.29", "172.31.69.30",
)

# Attack windows in order; of those that a row is in, the first counts. (day, subtype, class, attackers, victims, start, finish)
_SERVER, _WEB_SERVER, _WEB_ATTACKER = ("172.31.69.25", "18.217.21.148"), ("172.31.69.28", "18.218.83.150"), ("18.218.115.60",)
ATTACK_WINDOWS = (
    ("Wednesday-14-02-2018", "FTP-BruteForce", "BruteForce", ("172.31.70.4", "18.221.219.4"), _SERVER, "2018-02-14 14:32:00", "2018-02-14 16:09:00"),
    ("Wednesday-14-02-2018", "SSH-Bruteforce", "BruteForce", ("172.31.70.6", "13.58.98.64"), _SERVER, "2018-02-14 18:01:00", "2018-02-14 19:31:00"),
    ("Friday-16-02-2018", "DoS-SlowHTTPTest", "DoS", ("172.31.70.23", "13.59.126.31"), _SERVER, "2018-02-16 14:12:00", "2018-02-16 15:08:00"),
    ("Friday-16-02-2018", "DoS-Hulk", "DoS", ("172.31.70.16", "18.219.193.20"), _SERVER, "2018-02-16 17:45:00", "2018-02-16 18:19:00"),
    ("Wednesday-21-02-2018", "DDOS-LOIC-UDP", "DDoS", DDOS_ATTACKERS, _WEB_SERVER, "2018-02-21 14:09:00", "2018-02-21 14:43:00"),
    ("Wednesday-21-02-2018", "DDOS-HOIC", "DDoS", DDOS_ATTACKERS, _WEB_SERVER, "2018-02-21 18:05:00", "2018-02-21 19:05:00"),
    ("Friday-02-03-2018", "Bot", "Bot", ("18.219.211.138",), BOT_VICTIMS, "2018-03-02 14:11:00", "2018-03-02 19:55:00"),
    ("Thursday-01-03-2018", "Infiltration", "Infiltration", ("13.58.225.34",), ("172.31.69.13", "18.216.254.154"), "2018-03-01 13:53:00", "2018-03-01 14:55:00"),
    ("Thursday-01-03-2018", "Infiltration", "Infiltration", ("13.58.225.34",), ("172.31.69.13", "18.216.254.154"), "2018-03-01 18:00:00", "2018-03-01 19:38:00"),
    ("Thursday-22-02-2018", "Brute Force-Web", "WebBased", _WEB_ATTACKER, _WEB_SERVER, "2018-02-22 14:17:00", "2018-02-22 15:24:00"),
    ("Thursday-22-02-2018", "Brute Force-XSS", "WebBased", _WEB_ATTACKER, _WEB_SERVER, "2018-02-22 17:50:00", "2018-02-22 18:29:00"),
    ("Thursday-22-02-2018", "SQL Injection", "WebBased", _WEB_ATTACKER, _WEB_SERVER, "2018-02-22 20:15:00", "2018-02-22 20:29:00"),
    ("Friday-23-02-2018", "Brute Force-Web", "WebBased", _WEB_ATTACKER, _WEB_SERVER, "2018-02-23 14:03:00", "2018-02-23 15:03:00"),
    ("Friday-23-02-2018", "Brute Force-XSS", "WebBased", _WEB_ATTACKER, _WEB_SERVER, "2018-02-23 17:00:00", "2018-02-23 18:10:00"),
    ("Friday-23-02-2018", "SQL Injection", "WebBased", _WEB_ATTACKER, _WEB_SERVER, "2018-02-23 19:05:00", "2018-02-23 19:18:00"),
)
_ATTACKERS_2017, _VICTIMS_2017 = ("172.16.0.1", "205.174.165.73", "205.174.165.80"), ("192.168.10.50", "205.174.165.68")
WEB_WINDOWS_2017 = (
    ("Thursday-06-07-2017", "Brute Force-Web", "WebBased", _ATTACKERS_2017, _VICTIMS_2017, "2017-07-06 12:15:00", "2017-07-06 13:01:00"),
    ("Thursday-06-07-2017", "XSS", "WebBased", _ATTACKERS_2017, _VICTIMS_2017, "2017-07-06 13:15:00", "2017-07-06 13:36:00"),
    ("Thursday-06-07-2017", "SQL Injection", "WebBased", _ATTACKERS_2017, _VICTIMS_2017, "2017-07-06 13:35:00", "2017-07-06 13:43:00"),
)
# Classes whose captures are cut to the attack's endpoints first, and subtypes kept out of training as stress sets.
PRESLICE_CLASSES = ("BruteForce", "DoS", "DDoS")
STRESS_SETS = {
    ("BruteForce", "FTP-BruteForce"): "ftp_bruteforce_attempted_stress_set",
    ("DoS", "DoS-SlowHTTPTest"): "dos_slowhttptest_attempted_stress_set",
}
# Names and order of the trailing features of a flow.
TEMPORAL_FEATURES = (
    "Rolling_UDP_Sum", "Rolling_TCP_Sum", "Rolling_ACK_Sum", "Rolling_FIN_Sum", "Rolling_RST_Sum", "Rolling_fin_Sum", "Rolling_psh_Sum", "Rolling_SYN_Sum",
    "Rolling_ICMP_Sum", "Rolling_http_port", "Rolling_Average_Duration", "Rolling_DNS_Sum", "Rolling_vulnerable_port", "Rolling_packets_Sum",
    "Rolling_bipackets_Sum", "Unique_Ports_In_SourceDestination",
)

DIRECTIONS = ("bidirectional", "src2dst", "dst2src")


def flow_features() -> list[str]:
    """The 76 features of a flow in their order."""
    sizes = [f"{d}_{s}_ps" for d in DIRECTIONS for s in ("min", "mean", "stddev", "max")]
    gaps = [f"{d}_{s}_piat_ms" for d in DIRECTIONS for s in ("min", "mean", "stddev", "max")]
    flags = [f"{d}_{f}_packets" for d in DIRECTIONS for f in ("syn", "cwr", "ece", "urg", "ack", "psh", "rst", "fin")]
    core = [f"{d}_{c}" for d in DIRECTIONS for c in ("duration_ms", "packets", "bytes")]
    active = [f"bidirectional_{s}_{k}_ms" for k in ("active", "idle") for s in ("mean", "std", "max", "min")]
    rates = [f"{d}_{c}_per_second" for d in DIRECTIONS for c in ("bytes", "packets")]
    return [*sizes, *gaps, *flags, *core, "src_port", "dst_port", "protocol", *active, *rates, "down_up_bytes_ratio", "average_packet_size"]

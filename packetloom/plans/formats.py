"""Input formats the jobs understand.

Fixed values: column names (leading spaces included), label tokens and
assembly orders are those of the log formats; the ensemble's features are a choice among them.
"""

# Connection records
CONNECTION_LABEL = "traffic_decision"
CONNECTION_BENIGN = "normal"
CONNECTION_CATEGORICAL = ["protocol_type", "service", "flag"]
CONNECTION_ORDER = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "urgent", "hot", "num_failed_logins", "logged_in", "root_shell", "su_attempted",
    "num_root", "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds",
    "is_host_login", "is_guest_login", "count", "srv_count",
]

# Flow records
FLOW_LABEL = " Label"
FLOW_BENIGN = "BENIGN"
FLOW_UNLABELLED = "0"
FLOW_CATEGORICAL = [" Source IP", " Destination IP"]
FLOW_ORDER = [
    " Source IP", " Source Port", " Destination IP", " Destination Port", " Protocol",
    " Flow Duration", " Total Fwd Packets", " Total Backward Packets",
    "Total Length of Fwd Packets", " Total Length of Bwd Packets",
    " Fwd Packet Length Max", " Fwd Packet Length Min",
    " Fwd Packet Length Mean", " Fwd Packet Length Std",
    "Bwd Packet Length Max", " Bwd Packet Length Min",
    " Bwd Packet Length Mean", " Bwd Packet Length Std",
    "Flow Bytes/s", " Flow Packets/s",
]

# Ensemble features
ENSEMBLE_FEATURES = [
    " Protocol", " Destination Port", " Source Port",
    "Init_Win_bytes_forward", " Init_Win_bytes_backward",
]

# Host metrics
HOST_LABEL = "load"
HOST_FEATURES = ["hour", "memutil", "netutil"]

"""Inputs that queries and their twins share."""

#: Window features and a node table that the path queries and their twins share: (tree, node, feature, threshold,
#: left, right, value).
PATH_INPUTS = ("ah_rate_1d", "usb_count_1d", "http_n_http")
PATH_FEATURES = ("mean_ah_rate_1d", "max_ah_rate_1d", "std_ah_rate_1d", "mean_usb_count_1d", "max_usb_count_1d", "mean_http_n_http")
PATH_NODES = (
    (0, 0, 0, 0.35, 1, 2, 0.0), (0, 1, 4, 2.0, 3, 4, 0.0), (0, 2, -1, 0.0, -1, -1, 1.0), (0, 3, -1, 0.0, -1, -1, 4.5),
    (0, 4, 2, 0.25, 5, 6, 0.0), (0, 5, -1, 0.0, -1, -1, 3.25), (0, 6, -1, 0.0, -1, -1, 3.0),
    (1, 0, 5, 0.5, 1, 2, 0.0), (1, 1, 1, 1.0, 3, 4, 0.0), (1, 2, 3, 0.5, 5, 6, 0.0), (1, 3, -1, 0.0, -1, -1, 5.0),
    (1, 4, -1, 0.0, -1, -1, 2.0), (1, 5, -1, 0.0, -1, -1, 3.5), (1, 6, -1, 0.0, -1, -1, 2.75),
    (2, 0, -1, 0.0, -1, -1, 3.125),
    (3, 0, 4, 1.0, 1, 2, 0.0), (3, 1, 0, 0.2, 3, 4, 0.0), (3, 2, -1, 0.0, -1, -1, -0.75), (3, 3, -1, 0.0, -1, -1, 0.5),
    (3, 4, -1, 0.0, -1, -1, -0.25),
)
PATH_PSI, PATH_STEP = 16, 0.5
#: Columns whose flattened and scaled windows have a twin.
FLAT_COLUMNS = ("ah_rate_1d", "usb_count_1d", "http_n_http", "logon_n_logon")

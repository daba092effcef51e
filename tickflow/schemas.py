"""Column contracts of the library's tables.  ``seq`` is the order of arrival; ``utc`` counts ticks of 0.1 ns."""

from __future__ import annotations

HITS = "hub_id int, mbid bigint, seq bigint, domclk bigint, utc bigint, fmt int, lc_mode int, trigger_mode int, atwd_chip int, rec_len int, word1 int"
RECORD = "path string, offset bigint, rec_len int, fmt int, mbid bigint, utc bigint, payload binary"
TCAL = "hub_id int, mbid bigint, card int, seq bigint, dor_tx bigint, dor_rx bigint, dom_rx bigint, dom_tx bigint, dor_wf array<smallint>, dom_wf array<smallint>, gps_offset bigint"
REQUEST_ELEMENTS = "uid int, elem int, readout_type int, source_id int, first_utc bigint, last_utc bigint, dom_id bigint"
ISOCHRON = "mbid bigint, seq bigint, lower bigint, upper bigint, dor_mid bigint, dom_mid bigint, epsilon double, cable double, gps_offset bigint"

#: The largest signed 64-bit number marks the end of a stream.
EOS = (1 << 63) - 1
#: Ticks of a second, an hour and a day.
SECOND, HOUR, DAY = 10**10, 36 * 10**12, 864 * 10**12

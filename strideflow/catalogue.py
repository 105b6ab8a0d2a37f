"""The profile: messages, fields, sub-fields, component lanes and enumerations as dimension tables.

Only the messages that tests and queries use are built in; a full profile comes from the
user: as the two sheets of the public profile workbook, saved as CSV
(``Catalogue.from_sheets``), or as tables of the same columns (``Catalogue.from_tables``).
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .basetypes import named

# The message numbers of the format, by name.
MESSAGES = """
0 file_id|1 capabilities|2 device_settings|3 user_profile|4 hrm_profile|5 sdm_profile|6 bike_profile|7 zones_target|8 hr_zone|9 power_zone|10 met_zone|12 sport
13 training_settings|15 goal|18 session|19 lap|20 record|21 event|23 device_info|26 workout|27 workout_step|28 schedule|30 weight_scale|31 course|32 course_point
33 totals|34 activity|35 software|37 file_capabilities|38 mesg_capabilities|39 field_capabilities|49 file_creator|51 blood_pressure|53 speed_zone|55 monitoring
72 training_file|78 hrv|80 ant_rx|81 ant_tx|82 ant_channel_id|101 length|103 monitoring_info|106 slave_device|127 connectivity|128 weather_conditions|129 weather_alert
131 cadence_zone|132 hr|142 segment_lap|145 memo_glob|148 segment_id|149 segment_leaderboard_entry|150 segment_point|151 segment_file|158 workout_session
159 watchface_settings|160 gps_metadata|161 camera_event|162 timestamp_correlation|164 gyroscope_data|165 accelerometer_data|167 three_d_sensor_calibration|169 video_frame
174 obdii_data|177 nmea_sentence|178 aviation_attitude|184 video|185 video_title|186 video_description|187 video_clip|188 ohr_settings|200 exd_screen_configuration
201 exd_data_field_configuration|202 exd_data_concept_configuration|206 field_description|207 developer_data_id|208 magnetometer_data|209 barometer_data
210 one_d_sensor_calibration|211 monitoring_hr_data|216 time_in_zone|225 set|227 stress_level|229 max_met_data|258 dive_settings|259 dive_gas|262 dive_alarm
264 exercise_title|268 dive_summary|269 spo2_data|275 sleep_level|285 jump|289 aad_accel_features|290 beat_intervals|297 respiration_rate|302 hsa_accelerometer_data
304 hsa_step_data|305 hsa_spo2_data|306 hsa_stress_data|307 hsa_respiration_data|308 hsa_heart_rate_data|312 split|313 split_summary|314 hsa_body_battery_data
315 hsa_event|317 climb_pro|319 tank_update|323 tank_summary|346 sleep_assessment|370 hrv_status_summary|371 hrv_value|372 raw_bbi|375 device_aux_battery_info
376 hsa_gyroscope_data|387 chrono_shot_session|388 chrono_shot_data|389 hsa_configuration_data|393 dive_apnea_alarm|398 skin_temp_overnight
409 hsa_wrist_temperature_data|412 nap_event|470 sleep_disruption_severity_period|471 sleep_disruption_overnight_severity
"""
# Fields as "message: number name type [scale/offset] [units] [+ if a counter]".
FIELDS = """
file_id: 0 type file|1 manufacturer manufacturer|2 product uint16|3 serial_number uint32z|4 time_created date_time|5 number uint16|8 product_name string
session: 254 message_index message_index|253 timestamp date_time 1/0 s|0 event event|1 event_type event_type|2 start_time date_time|5 sport sport|7 total_elapsed_time uint32 1000/0 s|8 total_timer_time uint32 1000/0 s|9 total_distance uint32 100/0 m|10 total_cycles uint32 1/0 cycles|14 avg_speed uint16 1000/0 m/s|15 max_speed uint16 1000/0 m/s|18 avg_cadence uint8 1/0 rpm|19 max_cadence uint8 1/0 rpm|49 avg_altitude uint16 5/500 m|50 max_altitude uint16 5/500 m|71 min_altitude uint16 5/500 m|124 enhanced_avg_speed uint32 1000/0 m/s|125 enhanced_max_speed uint32 1000/0 m/s|126 enhanced_avg_altitude uint32 5/500 m|127 enhanced_min_altitude uint32 5/500 m|128 enhanced_max_altitude uint32 5/500 m|147 avg_respiration_rate uint8|148 max_respiration_rate uint8|149 min_respiration_rate uint8|169 enhanced_avg_respiration_rate uint16 100/0 Breaths/min|170 enhanced_max_respiration_rate uint16 100/0 Breaths/min|180 enhanced_min_respiration_rate uint16 100/0
lap: 254 message_index message_index|253 timestamp date_time 1/0 s|0 event event|1 event_type event_type|2 start_time date_time|7 total_elapsed_time uint32 1000/0 s|8 total_timer_time uint32 1000/0 s|9 total_distance uint32 100/0 m|10 total_cycles uint32 1/0 cycles|13 avg_speed uint16 1000/0 m/s|14 max_speed uint16 1000/0 m/s|17 avg_cadence uint8 1/0 rpm|18 max_cadence uint8 1/0 rpm|25 sport sport|42 avg_altitude uint16 5/500 m|43 max_altitude uint16 5/500 m|62 min_altitude uint16 5/500 m|110 enhanced_avg_speed uint32 1000/0 m/s|111 enhanced_max_speed uint32 1000/0 m/s|112 enhanced_avg_altitude uint32 5/500 m|113 enhanced_min_altitude uint32 5/500 m|114 enhanced_max_altitude uint32 5/500 m|136 enhanced_avg_respiration_rate uint16 100/0 Breaths/min|137 enhanced_max_respiration_rate uint16 100/0 Breaths/min|147 avg_respiration_rate uint8|148 max_respiration_rate uint8
length: 254 message_index message_index|253 timestamp date_time|0 event event|1 event_type event_type|2 start_time date_time|3 total_elapsed_time uint32 1000/0 s|4 total_timer_time uint32 1000/0 s|22 enhanced_avg_respiration_rate uint16 100/0 Breaths/min|23 enhanced_max_respiration_rate uint16 100/0 Breaths/min|24 avg_respiration_rate uint8|25 max_respiration_rate uint8
record: 253 timestamp date_time 1/0 s|0 position_lat sint32 1/0 semicircles|1 position_long sint32 1/0 semicircles|2 altitude uint16 5/500 m|3 heart_rate uint8 1/0 bpm|4 cadence uint8 1/0 rpm|5 distance uint32 100/0 m|6 speed uint16 1000/0 m/s|7 power uint16 1/0 watts|8 compressed_speed_distance byte 100/0 m/s,m|9 grade sint16 100/0 %|13 temperature sint8 1/0 C|18 cycles uint8 1/0 cycles +|19 total_cycles uint32 1/0 cycles|28 compressed_accumulated_power uint16 1/0 watts +|29 accumulated_power uint32 1/0 watts|73 enhanced_speed uint32 1000/0 m/s|78 enhanced_altitude uint32 5/500 m|99 respiration_rate uint8 1/0 s|108 enhanced_respiration_rate uint16 100/0 Breaths/min
event: 253 timestamp date_time 1/0 s|0 event event|1 event_type event_type|2 data16 uint16|3 data uint32|4 event_group uint8|7 score uint16|8 opponent_score uint16|9 front_gear_num uint8z|10 front_gear uint8z|11 rear_gear_num uint8z|12 rear_gear uint8z|15 start_timestamp date_time 1/0 s|21 radar_threat_level_max radar_threat_level_type|22 radar_threat_count uint8|23 radar_threat_avg_approach_speed uint8 10/0 m/s|24 radar_threat_max_approach_speed uint8 10/0 m/s
device_info: 253 timestamp date_time 1/0 s|0 device_index device_index|1 device_type uint8|2 manufacturer manufacturer|3 serial_number uint32z|4 product uint16|5 software_version uint16 100/0|6 hardware_version uint8|7 cum_operating_time uint32 1/0 s|10 battery_voltage uint16 256/0 V|11 battery_status battery_status|25 source_type source_type
hr: 253 timestamp date_time|0 fractional_timestamp uint16 32768/0 s|1 time256 uint8 256/0 s|6 filtered_bpm uint8 1/0 bpm|9 event_timestamp uint32 1024/0 s +|10 event_timestamp_12 byte 1/0 s
memo_glob: 250 part_index uint32|0 memo byte|1 mesg_num mesg_num|2 parent_index message_index|3 field_num uint8|4 data uint8z
workout_step: 254 message_index message_index|0 wkt_step_name string|1 duration_type wkt_step_duration|2 duration_value uint32|3 target_type wkt_step_target|4 target_value uint32|5 custom_target_value_low uint32|6 custom_target_value_high uint32|7 intensity intensity|8 notes string|19 secondary_target_type wkt_step_target|20 secondary_target_value uint32|21 secondary_custom_target_value_low uint32|22 secondary_custom_target_value_high uint32
field_description: 0 developer_data_index uint8|1 field_definition_number uint8|2 fit_base_type_id fit_base_type|3 field_name string|6 scale uint8|7 offset sint8|8 units string
developer_data_id: 0 developer_id byte|1 application_id byte|3 developer_data_index uint8
monitoring: 253 timestamp date_time 1/0 s|3 cycles uint32 2/0 cycles|5 activity_type activity_type|24 current_activity_type_intensity byte|28 intensity uint8
activity: 253 timestamp date_time|0 total_timer_time uint32 1000/0 s|1 num_sessions uint16|5 local_timestamp local_date_time
"""
# Sub-fields as "message.field: name type scale when reference=value,value".
SUBFIELDS = """
file_id.product: favero_product uint16 1 when manufacturer=263|garmin_product uint16 1 when manufacturer=1,15,13,89
session.total_cycles: total_strides uint32 1 when sport=1,11|total_strokes uint32 1 when sport=2,5,15,37
session.avg_cadence: avg_running_cadence uint8 1 when sport=1
session.max_cadence: max_running_cadence uint8 1 when sport=1
lap.total_cycles: total_strides uint32 1 when sport=1,11|total_strokes uint32 1 when sport=2,5,15,37
lap.avg_cadence: avg_running_cadence uint8 1 when sport=1
lap.max_cadence: max_running_cadence uint8 1 when sport=1
event.data: timer_trigger timer_trigger 1 when event=0|course_point_index message_index 1 when event=10|battery_level uint16 1000 when event=11|virtual_partner_speed uint16 1000 when event=12|hr_high_alert uint8 1 when event=13|hr_low_alert uint8 1 when event=14|speed_high_alert uint32 1000 when event=15|speed_low_alert uint32 1000 when event=16|cad_high_alert uint16 1 when event=17|cad_low_alert uint16 1 when event=18|power_high_alert uint16 1 when event=19|power_low_alert uint16 1 when event=20|time_duration_alert uint32 1000 when event=23|distance_duration_alert uint32 100 when event=24|calorie_duration_alert uint32 1 when event=25|fitness_equipment_state fitness_equipment_state 1 when event=27|sport_point uint32 1 when event=33|gear_change_data uint32 1 when event=42,43|rider_position rider_position_type 1 when event=44|comm_timeout comm_timeout_type 1 when event=47|dive_alert dive_alert 1 when event=56|auto_activity_detect_duration uint16 1 when event=54|radar_threat_alert uint32 1 when event=75
event.start_timestamp: auto_activity_detect_start_timestamp date_time 1 when event=54
device_info.device_type: ble_device_type ble_device_type 1 when source_type=3|antplus_device_type antplus_device_type 1 when source_type=1|ant_device_type uint8 1 when source_type=0|local_device_type local_device_type 1 when source_type=5
device_info.product: favero_product uint16 1 when manufacturer=263|garmin_product uint16 1 when manufacturer=1,15,13,89
workout_step.duration_value: duration_time uint32 1000 when duration_type=0,28|duration_distance uint32 100 when duration_type=1|duration_hr workout_hr 1 when duration_type=2,3|duration_calories uint32 1 when duration_type=4|duration_step uint32 1 when duration_type=6,7,8,9,10,11,12,13|duration_power workout_power 1 when duration_type=14,15|duration_reps uint32 1 when duration_type=29
workout_step.target_value: target_speed_zone uint32 1 when target_type=0|target_hr_zone uint32 1 when target_type=1|target_cadence_zone uint32 1 when target_type=3|target_power_zone uint32 1 when target_type=4|repeat_steps uint32 1 when duration_type=6|repeat_time uint32 1000 when duration_type=7|repeat_distance uint32 100 when duration_type=8|repeat_calories uint32 1 when duration_type=9|repeat_hr workout_hr 1 when duration_type=10,11|repeat_power workout_power 1 when duration_type=12,13|target_stroke_type swim_stroke 1 when target_type=11
workout_step.custom_target_value_low: custom_target_speed_low uint32 1000 when target_type=0|custom_target_heart_rate_low workout_hr 1 when target_type=1|custom_target_cadence_low uint32 1 when target_type=3|custom_target_power_low workout_power 1 when target_type=4
workout_step.custom_target_value_high: custom_target_speed_high uint32 1000 when target_type=0|custom_target_heart_rate_high workout_hr 1 when target_type=1|custom_target_cadence_high uint32 1 when target_type=3|custom_target_power_high workout_power 1 when target_type=4
workout_step.secondary_target_value: secondary_target_speed_zone uint32 1 when secondary_target_type=0|secondary_target_hr_zone uint32 1 when secondary_target_type=1|secondary_target_cadence_zone uint32 1 when secondary_target_type=3|secondary_target_power_zone uint32 1 when secondary_target_type=4|secondary_target_stroke_type swim_stroke 1 when secondary_target_type=11
workout_step.secondary_custom_target_value_low: secondary_custom_target_speed_low uint32 1000 when secondary_target_type=0|secondary_custom_target_heart_rate_low workout_hr 1 when secondary_target_type=1|secondary_custom_target_cadence_low uint32 1 when secondary_target_type=3|secondary_custom_target_power_low workout_power 1 when secondary_target_type=4
workout_step.secondary_custom_target_value_high: secondary_custom_target_speed_high uint32 1000 when secondary_target_type=0|secondary_custom_target_heart_rate_high workout_hr 1 when secondary_target_type=1|secondary_custom_target_cadence_high uint32 1 when secondary_target_type=3|secondary_custom_target_power_high workout_power 1 when secondary_target_type=4
monitoring.cycles: steps uint32 1 when activity_type=6,1|strokes uint32 2 when activity_type=2,5
"""
# Lanes from the lowest bit up, as "message.field[/sub-field]: name:bits", * where they accumulate.
LANES = """
session.avg_speed: enhanced_avg_speed:16
session.max_speed: enhanced_max_speed:16
session.avg_altitude: enhanced_avg_altitude:16
session.max_altitude: enhanced_max_altitude:16
session.min_altitude: enhanced_min_altitude:16
session.avg_respiration_rate: enhanced_avg_respiration_rate:8
session.max_respiration_rate: enhanced_max_respiration_rate:8
session.min_respiration_rate: enhanced_min_respiration_rate:8
lap.avg_speed: enhanced_avg_speed:16
lap.max_speed: enhanced_max_speed:16
lap.avg_altitude: enhanced_avg_altitude:16
lap.max_altitude: enhanced_max_altitude:16
lap.min_altitude: enhanced_min_altitude:16
lap.avg_respiration_rate: enhanced_avg_respiration_rate:8
lap.max_respiration_rate: enhanced_max_respiration_rate:8
length.avg_respiration_rate: enhanced_avg_respiration_rate:8
length.max_respiration_rate: enhanced_max_respiration_rate:8
record.altitude: enhanced_altitude:16
record.speed: enhanced_speed:16
record.compressed_speed_distance: speed:12 distance:12*
record.cycles: total_cycles:8*
record.compressed_accumulated_power: accumulated_power:16*
record.respiration_rate: enhanced_respiration_rate:8
event.data16: data:16
event.data/sport_point: score:16 opponent_score:16
event.data/gear_change_data: rear_gear_num:8 rear_gear:8 front_gear_num:8 front_gear:8
event.data/radar_threat_alert: radar_threat_level_max:8 radar_threat_count:8 radar_threat_avg_approach_speed:8 radar_threat_max_approach_speed:8
monitoring.current_activity_type_intensity: activity_type:5 intensity:3
hr.time256: fractional_timestamp:8
"""
LANES += "hr.event_timestamp_12: " + " ".join(["event_timestamp:12*"] * 10) + "\n"
# Enumerations, as far as they are public here; the rest is a parameter.
ENUMS = """
activity: 0 manual|1 auto_multi_sport
activity_type: 0 generic|1 running|2 cycling|3 transition|4 fitness_equipment|5 swimming|6 walking|8 sedentary|254 all
battery_status: 1 new|2 good|3 ok|4 low|5 critical|6 charging|7 unknown
event: 0 timer|3 workout|4 workout_step|5 power_down|6 power_up|7 off_course|8 session|9 lap|10 course_point|11 battery|12 virtual_partner_pace|13 hr_high_alert|14 hr_low_alert|15 speed_high_alert|16 speed_low_alert|17 cad_high_alert|18 cad_low_alert|19 power_high_alert|20 power_low_alert|21 recovery_hr|22 battery_low|23 time_duration_alert|24 distance_duration_alert|25 calorie_duration_alert|26 activity|27 fitness_equipment|28 length|32 user_marker|33 sport_point|36 calibration|42 front_gear_change|43 rear_gear_change|44 rider_position_change|45 elev_high_alert|46 elev_low_alert|47 comm_timeout|54 auto_activity_detect|56 dive_alert|75 radar_threat_alert
event_type: 0 start|1 stop|2 consecutive_depreciated|3 marker|4 stop_all|5 begin_depreciated|6 end_depreciated|7 end_all_depreciated|8 stop_disable|9 stop_disable_all
file: 1 device|2 settings|3 sport|4 activity|5 workout|6 course|7 schedules|9 weight|10 totals|11 goals|14 blood_pressure|15 monitoring_a|20 activity_summary|28 monitoring_daily|32 monitoring_b|34 segment|35 segment_list|40 exd_configuration
intensity: 0 active|1 rest|2 warmup|3 cooldown|4 recovery|5 interval|6 other
manufacturer: 1 garmin|13 dynastream_oem|15 dynastream|89 tacx|263 favero_electronics
source_type: 0 ant|1 antplus|2 bluetooth|3 bluetooth_low_energy|4 wifi|5 local
sport: 0 generic|1 running|2 cycling|3 transition|4 fitness_equipment|5 swimming|6 basketball|7 soccer|8 tennis|9 american_football|10 training|11 walking|12 cross_country_skiing|13 alpine_skiing|14 snowboarding|15 rowing|16 mountaineering|17 hiking|18 multisport|19 paddling|20 flying|21 e_biking|22 motorcycling|23 boating|24 driving|25 golf|26 hang_gliding|27 horseback_riding|28 hunting|29 fishing|30 inline_skating|31 rock_climbing|32 sailing|33 ice_skating|34 sky_diving|35 snowshoeing|36 snowmobiling|37 stand_up_paddleboarding|38 surfing|39 wakeboarding|40 water_skiing|41 kayaking|42 rafting|43 windsurfing|44 kitesurfing|45 tactical|46 jumpmaster|47 boxing|48 floor_climbing
swim_stroke: 0 freestyle|1 backstroke|2 breaststroke|3 butterfly|4 drill|5 mixed|6 im
timer_trigger: 0 manual|1 auto|2 fitness_equipment
wkt_step_duration: 0 time|1 distance|2 hr_less_than|3 hr_greater_than|4 calories|5 open|6 repeat_until_steps_cmplt|7 repeat_until_time|8 repeat_until_distance|9 repeat_until_calories|10 repeat_until_hr_less_than|11 repeat_until_hr_greater_than|12 repeat_until_power_less_than|13 repeat_until_power_greater_than|14 power_less_than|15 power_greater_than|28 repetition_time|29 reps
wkt_step_target: 0 speed|1 heart_rate|2 open|3 cadence|4 power|5 grade|6 resistance|11 swim_stroke
"""


def _listed(cell: str) -> list[str]:
    return [x.strip() for x in cell.split(",") if x.strip()]


@dataclass
class Catalogue:
    """Rows of the five dimension tables."""

    messages: list[tuple] = field(default_factory=list)  # mesg_num, name
    fields: list[tuple] = field(default_factory=list)  # mesg_num, fdn, name, type, scale, offset, units, accumulate, bits
    subfields: list[tuple] = field(default_factory=list)  # mesg_num, fdn, order, name, type, scale, offset, units, ref_fdn, value
    lanes: list[tuple] = field(default_factory=list)  # mesg_num, fdn, subfield or "", order, name, shift, bits, accumulate
    enums: list[tuple] = field(default_factory=list)  # type, value, name

    MESSAGE_COLUMNS = "mesg_num int, mesg_name string"
    FIELD_COLUMNS = "mesg_num int, fdn int, name string, type string, scale double, offset double, units string, accumulate boolean, bits int"
    SUBFIELD_COLUMNS = "mesg_num int, fdn int, ord int, name string, type string, scale double, offset double, units string, ref_fdn int, value long"
    LANE_COLUMNS = "mesg_num int, fdn int, subfield string, ord int, name string, shift int, bits int, accumulate boolean"
    ENUM_COLUMNS = "type string, value long, name string"

    @classmethod
    def built_in(cls) -> Catalogue:
        out = cls()
        numbers = {}
        for item in MESSAGES.replace("\n", "|").strip("|").split("|"):
            n, name = item.split()
            numbers[name] = int(n)
            out.messages.append((int(n), name))
        at: dict[tuple[str, str], tuple] = {}
        for line in FIELDS.strip().splitlines():
            mesg, items = line.split(": ", 1)
            for item in items.split("|"):
                counter = item.endswith(" +")
                fdn, name, kind, *more = item.removesuffix(" +").split()
                scale, offset = map(float, more[0].split("/")) if more else (1.0, 0.0)
                bits = 8 * (named(kind).size if named(kind) else 4)
                row = (numbers[mesg], int(fdn), name, kind, scale, offset, more[1] if len(more) > 1 else None, counter, bits)
                at[mesg, name] = row
                out.fields.append(row)
        for line in SUBFIELDS.strip().splitlines():
            parent, items = line.split(": ", 1)
            mesg, name = parent.split(".")
            num, fdn, units = at[mesg, name][0], at[mesg, name][1], at[mesg, name][6]
            for k, item in enumerate(items.split("|")):
                what, condition = item.split(" when ")
                sub, kind, scale = what.split()
                ref, values = condition.split("=")
                for v in values.split(","):
                    out.subfields.append((num, fdn, k, sub, kind, float(scale), 0.0, units, at[mesg, ref][1], int(v, 0)))
        for line in LANES.strip().splitlines():
            parent, items = line.split(": ", 1)
            mesg, name = parent.split(".")
            name, _, sub = name.partition("/")
            shift = 0
            for k, item in enumerate(items.split()):
                lane, bits = item.rstrip("*").split(":")
                out.lanes.append((*at[mesg, name][:2], sub, k, lane, shift, int(bits), item.endswith("*")))
                shift += int(bits)
        for line in ENUMS.strip().splitlines():
            kind, items = line.split(": ", 1)
            out.enums += [(kind, int(i.split()[0]), i.split()[1]) for i in items.split("|")]
        out.enums += [("mesg_num", n, name) for n, name in out.messages]
        return out

    @classmethod
    def from_tables(cls, messages: DataFrame, fields: DataFrame, subfields: DataFrame, lanes: DataFrame, enums: DataFrame) -> Catalogue:
        """A user's profile; it is a schema and small, so it is held by the driver."""
        order = ("messages", "MESSAGE_COLUMNS"), ("fields", "FIELD_COLUMNS"), ("subfields", "SUBFIELD_COLUMNS"), ("lanes", "LANE_COLUMNS"), ("enums", "ENUM_COLUMNS")
        frames = dict(messages=messages, fields=fields, subfields=subfields, lanes=lanes, enums=enums)
        return cls(**{k: [tuple(r) for r in frames[k].select(*[c.split()[0] for c in getattr(cls, cols).split(", ")]).collect()] for k, cols in order})

    @classmethod
    def from_sheets(cls, types: str, messages: str) -> Catalogue:
        """A profile from the texts of its two sheets, as CSV with a header line.

        Types: Type Name, Base Type, Value Name, Value. Messages: Message Name, Field Def #,
        Field Name, Field Type, Array, Components, Scale, Offset, Units, Bits, Accumulate,
        Ref Field Name, Ref Field Value. Names stand in the first row of what they head.
        A row with a name but no number is a sub-field of the field above it. Message
        numbers are the values of the type mesg_num. Columns are found by name; others are
        not read. Scales and offsets of packed fields are their lanes' affair.
        """
        out, base, kind = cls(), {}, ""
        for row in csv.DictReader(io.StringIO(types)):
            kind = row["Type Name"] or kind
            if row["Base Type"]:
                base[kind] = row["Base Type"]
            if row["Value Name"] and row["Value"]:
                out.enums.append((kind, int(row["Value"], 0), row["Value Name"]))
        values = {(k, name): v for k, v, name in out.enums}
        out.messages = [(v, name) for k, v, name in out.enums if k == "mesg_num"]
        numbers = {name: n for n, name in out.messages}
        rows, mesg, fdn, order, listed = [], None, None, 0, {}
        for row in csv.DictReader(io.StringIO(messages)):
            row = {k: (v or "").strip() for k, v in row.items() if k}
            if row["Message Name"]:
                mesg = numbers.get(row["Message Name"])
            if mesg is None or not row["Field Name"]:
                continue
            sub = not row["Field Def #"]
            fdn, order = (fdn, order + 1) if sub else (int(row["Field Def #"], 0), -1)
            rows.append((mesg, fdn, order, row))
            if not sub:
                listed[mesg, row["Field Name"]] = (fdn, row["Field Type"])
        for mesg, fdn, order, row in rows:
            lanes = _listed(row["Components"])
            one = lambda name, default: float(row[name]) if row[name] and not len(lanes) > 1 and "," not in row[name] else default  # noqa: B023, E731
            scale, offset, units, of = one("Scale", 1.0), one("Offset", 0.0), row["Units"] or None, base.get(row["Field Type"], row["Field Type"])
            name = row["Field Name"]
            if order < 0:
                counter = not lanes and row["Accumulate"] == "1"
                out.fields.append((mesg, fdn, name, row["Field Type"], scale, offset, units, counter, 8 * (named(of).size if named(of) else 4)))
            for ref, value in zip(_listed(row["Ref Field Name"]), _listed(row["Ref Field Value"]), strict=False) if order >= 0 else ():
                at, ref_type = listed.get((mesg, ref), (None, None))
                number = values.get((ref_type, value))
                if number is None and value[:1].isdigit():
                    number = int(value, 0)
                if at is not None and number is not None:
                    out.subfields.append((mesg, fdn, order, name, row["Field Type"], scale, offset, units, at, number))
            shift = 0
            for k, (lane, bits) in enumerate(zip(lanes, _listed(row["Bits"]), strict=False)):
                wraps = _listed(row["Accumulate"])
                out.lanes.append((mesg, fdn, name if order >= 0 else "", k, lane, shift, int(bits), wraps[k : k + 1] == ["1"]))
                shift += int(bits)
        return out

    def table(self, spark: SparkSession, which: str) -> DataFrame:
        columns = {"messages": self.MESSAGE_COLUMNS, "fields": self.FIELD_COLUMNS, "subfields": self.SUBFIELD_COLUMNS, "lanes": self.LANE_COLUMNS, "enums": self.ENUM_COLUMNS}
        return spark.createDataFrame(getattr(self, which), columns[which])

    def number(self, name: str) -> int | None:
        return next((n for n, m in self.messages if m == name), None)

    def enum_value(self, kind: str, name: str) -> int | None:
        return next((v for t, v, n in self.enums if t == kind and n == name), None)

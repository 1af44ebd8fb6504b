"""Tables of the rules catalogue, as DDL; a folder of Parquet files named like them is a catalogue."""

TABLES = {
    "core_rules": "id bigint, slug string, title string, category string, content string, order_index int",
    "factions": "id bigint, slug string, name string, parent_faction_id bigint, is_subfaction boolean, army_rules string, lore string",
    "detachments": "id bigint, slug string, name string, faction_id bigint, rule_name string, rule_text string",
    "units": "id bigint, slug string, name string, faction_id bigint, movement string, toughness int, save string, wounds int, leadership string, objective_control int, points_cost int",
    "weapons": "id bigint, name string, weapon_type string, range string, attacks string, skill string, strength string, armor_penetration string, damage string, abilities string",
    "unit_weapons": "unit_id bigint, weapon_id bigint, is_default boolean",
    "abilities": "id bigint, slug string, name string, ability_type string, description string, faction_id bigint",
    "unit_abilities": "unit_id bigint, ability_id bigint",
    "keywords": "id bigint, name string, keyword_type string, description string",
    "unit_keywords": "unit_id bigint, keyword_id bigint",
    "stratagems": "id bigint, slug string, name string, faction_id bigint, detachment_id bigint, cp_cost string, phase string, effect string",
    "enhancements": "id bigint, slug string, name string, detachment_id bigint, points_cost int, description string, restrictions string",
    "faqs": "id bigint, slug string, question string, answer string, category string, faction_id bigint",
    "missions": "id bigint, slug string, name string, mission_type string, primary_objective string",
    "secondary_objectives": "id bigint, slug string, name string, category string, description string",
}
EVENTS = "id string, game_id bigint, ts double, round int, phase string, player int, type string, unit_id string, flag boolean, text string, amount int"
SEGMENTS = "video_id bigint, seq int, start double, duration double, text string"

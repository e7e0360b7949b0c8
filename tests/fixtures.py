"""Small invented inputs, one for each shape of messy table."""

CLEAN = """shipment_id,origin_hub,destination_hub,material_type,weight_kg,predicted_delay_hours,status
SHP-71,Lisbon,Denver,Ceramics,310.25,6.5,queued
SHP-72,Quito,Lima,Timber,980,3,in_transit
SHP-73,Perth,Cairo,Textiles,61.4,0,delivered
SHP-74,Accra,Riga,Paint,505.5,31,delayed
SHP-75,Turin,Graz,Coffee,140,1.5,queued
"""

ALIASED = """uid,source,target,cargo,mass,delay,state
SHP-810,LISBON,QUITO,Glass panes,40.5,0,held
SHP-811,QUITO,PERTH,Bicycle frames,71.0,2.25,late
SHP-812,PERTH,ACCRA,Cut flowers,6.75,5.5,urgent
SHP-813,ACCRA,LISBON,Camera lenses,2.2,0,closed
SHP-814,LISBON,PERTH,Lathe parts,96.25,0.4,held
SHP-815,QUITO,ACCRA,Paper rolls,33.0,0,closed"""

# three header rows, a repeated id, blank cells, status in mixed case
CHAOTIC = """Consignment,,Journey,,Load,Forecast,Progress
Parcel ref,,Stops,,Goods,Lateness,Stage
ID,Type,From_hub,To_hub,Mass class,Hours late,State
""" + "".join(
    f"SHP-{40 + n % 19},{'' if n in (8, 13) else kind},{start},{end},{'' if n in (8, 13) else goods},{'' if n in (6, 14) else late},{state}\n"
    for n, (kind, start, end, goods, late, state) in enumerate(
        (
            ("Ceramics", "Timber", "Textiles", "Paint", "Coffee")[n % 5],
            ("BOSTON", "DENVER", "MIAMI", "DALLAS")[n % 4],
            ("SEATTLE", "ATLANTA", "HOUSTON")[n % 3],
            ("crate", "pallet", "drum", "sack")[n % 4],
            n * 3.5,
            ("queued", "Queued", "lost", "DELIVERED", "slight_delay")[n % 5],
        )
        for n in range(20)
    )
)

SEGMENTED = """ID,Person,,
Joined,Points,,
Remark,,,
7,Nadia,,
2021-05-04,61,,
Slow start,,,
8,Tomas,,
2021-06-09,74,,
Steady climb,,,
"""

POSITIONAL = """ID,Person,Points,Joined,
7,Nadia,,,
,,61,2021-05-04,
8,Tomas,,,
,,74,2021-06-09,
"""

STREAMED = """ID,Person,Age
5,Nadia,41,6
Tomas,52,7,Irena
28
"""

SCIENTIFIC = "\n".join(
    "\t".join([*line, *[""] * (9 - len(line))])
    for line in [
        ["plot_id", "depth", "soil", "rain_mm", "sun_hours", "", "", "runoff", "humidity"],
        ["crop_name", "canopy_index", "root_index"],
        ["yield_kg", "pest_score", "risk_level", "quality"],
        *[
            line
            for n, soil, crop, risk in ((31, "Loam", "Barley", "Low"), (32, "Clay", "Barley", "Low"), (33, "Sand", "Oats", "High"), (34, "Loam", "Rye", "Low"))
            for line in (
                [str(n), str(n - 13), soil, f"{n * 0.13:.2f}", f"{n * 0.21:.2f}", "", "", f"{n * 0.17:.2f}", f"{n * 2.07:.2f}"],
                [crop, f"{n * 0.09:.2f}", f"{n * 0.3:.1f}"],
                [f"{n * 8.51:.2f}", f"{n * 0.37:.2f}", risk, f"{n * 1.93:.2f}"],
            )
        ],
    ]
)

ANCHORED = "order_id,item,price\nnote before,,\n" + "\n".join(
    f"ORD-{i},widget {i},{i}.5\nextra line {i},," + ("\nsecond extra,," if i % 3 == 0 else "") for i in range(1, 15)
)

FILES = {
    "segmented": SEGMENTED,
    "positional": POSITIONAL,
    "streamed": STREAMED,
    "scientific": SCIENTIFIC,
    "anchored": ANCHORED,
    "clean": CLEAN,
    "chaotic": CHAOTIC,
}

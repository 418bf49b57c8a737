from aerocal.sources.station import (  # noqa: F401
    file_report,
    missing_files,
    read_station_files,
    station_readings,
)
from aerocal.sources.tables import (  # noqa: F401
    load_model,
    read_hourly_station,
    read_met_station,
    read_sensor_2023,
    read_sensor_report,
    read_station_table,
)

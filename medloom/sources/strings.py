"""Interface texts in two languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medloom.schemas import STRINGS

# Key, English, Russian. {app} is the name of the application.
TEXTS = [
    ("profile_title", "{app} Profile", "Профиль {app}"),
    ("section_personal", "Personal Information", "Личная информация"),
    ("field_name", "Full Name", "Полное имя"),
    ("field_birthdate", "Birth Date", "Дата рождения"),
    ("field_gender", "Gender", "Пол"),
    ("gender_male", "Male", "Мужской"),
    ("gender_female", "Female", "Женский"),
    ("gender_other", "Other", "Другой"),
    ("section_health", "Health Data", "Данные о здоровье"),
    ("field_blood", "Blood Type", "Группа крови"),
    ("field_height", "Height (cm)", "Рост (см)"),
    ("field_weight", "Weight (kg)", "Вес (кг)"),
    ("section_settings", "App Settings", "Настройки приложения"),
    ("field_language", "UI Language", "Язык интерфейса"),
    ("button_save", "Save", "Сохранить"),
    ("tab_profile", "Profile", "Профиль"),
    ("tab_vault", "Vault", "Сейф"),
    ("tab_brain", "Brain", "Мозг"),
    ("vault_empty_title", "No Tests", "Нет анализов"),
    ("vault_empty_desc", "No medical tests found. Add your first one!", "Анализы не найдены. Добавьте первый тест!"),
    ("add_test_section", "Test Details", "Детали анализа"),
    ("field_test_name", "Test Name", "Название анализа"),
    ("field_provider", "Provider/Lab", "Лаборатория"),
    ("field_date", "Test Date", "Дата анализа"),
    ("add_test_title", "New Analysis", "Новый анализ"),
    ("test_detail_title", "Test Details", "Детали анализа"),
    ("button_scan", "Scan Document", "Сканировать документ"),
    ("button_camera", "Take Photo", "Сфотографировать"),
    ("button_photos", "Scan Photos", "Выбрать фото"),
    ("button_pdf", "Import PDF", "Импорт PDF"),
    (
        "disclaimer_data_only",
        "For informational purposes only. This is not a diagnosis or medical advice. Consult a licensed physician.",
        "Только для информации. Это не диагноз и не медицинская рекомендация. Обратитесь к врачу.",
    ),
    ("brain_input_placeholder", "Ask {app}...", "Спросите {app}..."),
    (
        "brain_disclaimer_footer",
        "This assistant organizes data; it does not diagnose. Consult a physician.",
        "Ассистент организует данные, но не ставит диагноз. Обратитесь к врачу.",
    ),
    (
        "error_no_context",
        "No matching records found. Add lab results first, or ask a general question.",
        "Подходящих записей не найдено. Сначала добавьте анализы или задайте общий вопрос.",
    ),
    (
        "brain_welcome_message",
        "Ask me about your latest lab results, trends, or what to discuss with your doctor.",
        "Спросите меня о последних анализах, тенденциях или о чём обсудить с врачом.",
    ),
]


def strings(spark: SparkSession, app: str = "Health") -> DataFrame:
    """(lang, key, text), two rows for each key."""
    rows = [(lang, key, text.replace("{app}", app)) for key, *texts in TEXTS for lang, text in zip(("English", "Русский"), texts)]
    return spark.createDataFrame(rows, STRINGS)
